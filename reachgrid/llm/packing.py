"""Best-fit packing of tokenised documents by bin completion.

Only how often each length occurs decides how pieces share sequences, and there
are at most ``capacity`` lengths. So Spark counts the lengths, a branch-and-bound
search over those counts gives a plan of fillings ("these lengths together, so
many times"), and every piece finds its place by its rank among the pieces of
its length. The driver sees the counts only; ranks are totals over many tasks.

Search: around the largest length left, all undominated fillings are enumerated, least
waste first: none in which a piece left out could take the room of some pieces in it
and of the waste. A filling may waste no more than all sequences together may if they
are to be fewer than the incumbent's, and a branch ends when its sequences plus the
lower bound of what is left (total length, and Martello and Toth's bound) reach the
incumbent; the first incumbent is best-fit decreasing. A filling is used as often as it
goes or once, after which all fillings are options again. ``max_nodes`` fillings are
looked at; the incumbent holds then. Below that bound the plan is optimal. Steps far back
keep their choice only and find their options again, so memory does not go with the depth.

Defined results: a null text is empty and gives the closing id alone; rows that
repeat are packed each; long texts are cut into pieces of ``capacity`` and encoded whole;
pieces of equal length, also of equal hash, doc_id and number, take places in any order;
an empty table gives no rows; ``pieces`` reads doc_id and text alone, whatever else a table
has, and ``pack`` needs columns other than sequence_id and offset.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.numbering import bucketed, running_total
from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, text_or_empty
from reachgrid.llm.tokens import public_path, word_tokens

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Texts are tokenised about so many characters at a time.
_CHARS = 2_000_000
#: Steps of the search, from the latest back, that keep the options they have left.
_ALIVE = 32

PIECE = "doc_id {id}, piece int, start long, length long, ids_crc32 long"


def _slices(sizes: list[int]) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, own in enumerate(sizes):
        size += own
        if size >= _CHARS:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(sizes):
        yield at, len(sizes)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): each document's ids and a closing 0.

    Documents of more than ``capacity`` ids are cut into pieces of that many;
    the last piece may be shorter.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = PIECE.format(id=kind) + (", ids array<int>" if keep_ids else "")
    end = np.array([END_ID], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = 4 * capacity
        encoder = word_tokens(tokenizer)
        for batch in batches:
            texts = batch.column(1)
            for a, b in _slices(pc.utf8_length(texts).to_pylist()):
                rows, numbers, lengths, sums, ids = [], [], [], [], []
                for i, data in enumerate(encoder.ids(texts.slice(a, b - a).to_pylist()), a):
                    data += end
                    for n, at in enumerate(range(0, len(data), step)):
                        part = data[at : at + step]
                        rows.append(i)
                        numbers.append(n)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(np.frombuffer(part, dtype="<i4"))
                number = np.array(numbers, dtype=np.int32)
                out = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    out.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Fewest sequences that the counted lengths may take: total length, and Martello and Toth's L2."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // capacity)
    many = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # pieces of at least this length
    mass = np.concatenate([np.cumsum((counts * sizes)[::-1])[::-1], [0]])
    half = capacity // 2 + 1
    for k in range(0, capacity // 2 + 1, max(1, capacity // 256)):
        high = max(capacity - k + 1, half)
        alone = int(many[min(high, len(counts))])  # longer than capacity - k
        middle = int(many[half]) - alone  # over half, up to capacity - k
        room = middle * capacity - int(mass[half] - mass[min(high, len(counts))])
        small = int(mass[min(k, len(counts))] - mass[half]) if k < half else 0
        best = max(best, alone + middle + max(0, -(-(small - room) // capacity)))
    return best


def _best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Plan that puts each length, longest first, where it leaves the least room."""
    open_bins: dict[int, list[list]] = {}  # room left -> [how many, filling]
    for size in range(len(counts) - 1, 0, -1):
        left = int(counts[size])
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                each = capacity // size
                many, rest = divmod(left, each)
                if many:
                    open_bins.setdefault(capacity - each * size, []).append([many, [(size, each)]])
                if rest:
                    open_bins.setdefault(capacity - rest * size, []).append([1, [(size, rest)]])
                break
            many, filling = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room]
            each = min(room // size, left)
            used = min(many, left // each)
            if used < many:
                open_bins.setdefault(room, []).append([many - used, filling])
            open_bins.setdefault(room - each * size, []).append([used, [*filling, (size, each)]])
            left -= used * each
    return [(many, filling) for found in open_bins.values() for many, filling in found]


def _fillings(counts: list[int], room: int, waste: int) -> Iterator[list[tuple[int, int]] | None]:
    """Undominated fillings of ``room`` that waste at most ``waste``, least waste and largest lengths first.

    None stands for a filling that was looked at and is dominated, so that callers can bound their work.
    """
    sizes = [s for s in range(1, min(room, len(counts) - 1) + 1) if counts[s]]
    full = (1 << (room + 1)) - 1
    reach = [1]  # bit t: the lengths so far can sum to t
    for s in sizes:
        bits, left, step = reach[-1], min(counts[s], room // s), 1
        while left:
            n = min(step, left)
            bits |= bits << (s * n) & full
            left -= n
            step *= 2
        reach.append(bits)
    for goal in range(reach[-1].bit_length() - 1, max(-1, room - waste - 1), -1):
        if not reach[-1] >> goal & 1:
            continue
        stack: list[tuple[int, int, list[tuple[int, int]]]] = [(len(sizes), goal, [])]
        while stack:
            i, want, taken = stack.pop()
            if not want:
                yield None if _dominated(counts, sizes, taken, room - goal) else taken
                continue
            while i and sizes[i - 1] > want:
                i -= 1
            if i:
                s = sizes[i - 1]
                for n in range(min(counts[s], want // s) + 1):
                    if reach[i - 1] >> (want - n * s) & 1:
                        stack.append((i - 1, want - n * s, [*taken, (s, n)] if n else taken))


def _dominated(counts: list[int], sizes: list[int], taken: list[tuple[int, int]], waste: int) -> bool:
    """Whether a piece that is left out could take the room of some pieces of ``taken``, or of none, and of the waste.

    What it takes the place of fits wherever that piece would have gone, so the changed filling is as good or better
    (Martello and Toth's criterion, one exchange at a time; any dominating filling gives such an exchange).
    """
    sums = 1  # bit t: some of the pieces taken sum to t
    held = dict(taken)
    for s, n in taken:
        for _ in range(n):
            sums |= sums << s
    for x in sizes:
        if counts[x] > held.get(x, 0):
            low = max(0, x - waste)
            # A piece in place of its equal is no exchange.
            high = x - 1 if x in held else x
            if high >= low and sums >> low & (1 << (high - low + 1)) - 1:
                return True
    return False


def plan(counts: dict[int, int], capacity: int = CAPACITY, max_nodes: int = 6000) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(how many sequences, [(length, pieces of it in each)])] that uses up ``counts``."""
    table = np.zeros(capacity + 1, dtype=np.int64)
    for size, many in counts.items():
        table[size] = many
    best = _best_fit_decreasing(table, capacity)
    fewest = sum(many for many, _ in best)
    least = lower_bound(table, capacity)
    seen: dict[bytes, int] = {}

    def options(left: list[int], used: int, most: int) -> Iterator[tuple[int, dict[int, int]] | None]:
        """(how often, filling) around the largest length left, for less than ``most`` sequences: as often as it goes, then once."""
        size = next(s for s in range(capacity, 0, -1) if left[s])
        waste = (most - 1 - used) * capacity - sum(s * n for s, n in enumerate(left) if n)
        rest = left.copy()
        rest[size] -= 1
        for found in _fillings(rest, capacity - size, waste):
            if found is None:
                yield None
                continue
            filling = {size: 1}
            for s, n in found:
                filling[s] = filling.get(s, 0) + n
            for many in sorted({1, min(left[s] // n for s, n in filling.items())}, reverse=True):
                yield many, filling

    def opened(step: list) -> tuple[list[int], Iterator[tuple[int, dict[int, int]] | None]]:
        """Lengths left at a step and its options not tried yet, from what the step keeps."""
        used, chosen, most, tried = step
        left = table.tolist()
        while chosen:
            (many, filling), chosen = chosen
            for s, n in filling:
                left[s] -= n * many
        return left, islice(options(left, used, most), tried, None)

    # Depth first: [sequences so far, plan so far as a linked list, fewest sequences as the step began, options tried].
    # Options hold far more than that: only the latest steps keep theirs, others find them again when the search is back.
    stack: list[list] = [[0, None, fewest, 0]] if fewest > least else []
    alive: dict[int, tuple[list[int], Iterator]] = {}
    nodes = 0
    while stack and fewest > least and nodes < max_nodes:
        depth = len(stack)
        if depth not in alive:
            alive[depth] = opened(stack[-1])
        (left, rest), (used, chosen, *_) = alive[depth], stack[-1]
        option = next(rest, ())
        nodes += 1
        stack[-1][3] += 1
        if option == ():
            stack.pop()
            del alive[depth]
        if not option:
            continue
        many, filling = option
        now, next_ = used + many, left.copy()
        for s, n in filling.items():
            next_[s] -= n * many
        made = ((many, list(filling.items())), chosen)
        if not any(next_):
            if now < fewest:
                fewest, best = now, []
                while made:
                    best.append(made[0])
                    made = made[1]
            continue
        array = np.array(next_)
        if now + lower_bound(array, capacity) >= fewest:
            continue
        key = hashlib.blake2b(array.tobytes(), digest_size=16).digest()
        if seen.get(key, now + 1) > now:
            seen[key] = now
            stack.append([now, made, fewest, 0])
            alive[depth + 1] = next_, options(next_, now, fewest)
            alive.pop(depth + 1 - _ALIVE, None)
    return best


def _places(fillings: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """Per length, which ranks each filling takes: ``key`` is length and first rank together."""
    taken: dict[int, int] = {}
    rows = []
    first = 0
    for many, filling in fillings:
        offset = 0
        for size, each in filling:
            start = taken.get(size, 0)
            rows.append((size << 40 | start, start, each, first, offset))
            taken[size] = start + many * each
            offset += size * each
        first += many
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return dict(zip(("key", "start", "each", "first", "offset"), table.T.copy()))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, start, length, ...) with sequence_id and offset."""
    parts = written(parts, "pieces")
    # At most ``capacity`` rows.
    histogram = parts.groupBy("length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["_n"] for r in histogram.collect()}
    places = _places(plan(counts, capacity))
    mixed = F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 33)
    sizes = parts.sparkSession.createDataFrame([(int(k), int(v)) for k, v in counts.items()], "length long, _n long")
    rows = parts.withColumn("_mixed", mixed).withColumn("_one", F.lit(1).cast("long")).join(F.broadcast(sizes), "length")
    rows = bucketed(rows, ["length"], F.col("_mixed"), F.col("_n")).drop("_n")
    rows = running_total(rows, ["length"], [F.col("_mixed"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")], "_one", "_rank", inclusive=False)
    rows = rows.select(*parts.columns, "_rank")

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            size, rank = frame["length"].to_numpy(np.int64), frame.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(places["key"], size << 40 | rank, side="right") - 1
            which, slot = np.divmod(rank - places["start"][at], places["each"][at])
            yield frame.assign(sequence_id=places["first"][at] + which, offset=places["offset"][at] + slot * size)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema)
    return rows.mapInPandas(place, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Documents as pieces with their place in sequences of at most ``capacity`` ids."""
    return pack(pieces(docs, tokenizer or public_path(TOKENIZER), capacity, keep_ids), capacity)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir), keep_ids=False)
