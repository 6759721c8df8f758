"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts of up to four bytes is counted over the training
documents by Spark. A symbol is coded in the longest context that was seen; where it
was not seen there, an escape (method C: as many escapes as distinct symbols) leads
to the next shorter context, in which the symbols of the longer one are excluded.
The trie is pretrained and fixed, so what each context contributes (its escape, and
the next context's total without its symbols) is worked out once per context and
texts are scored by table look-ups for whole arrays of positions.

The whole trie counts. Its head is broadcast: orders 0 and 1, and of each longer order
the most frequent contexts with all their symbols, at most ``max_entries`` entries. A
head context's suffixes are in the head too, so a symbol whose longest context is there
is scored from the head alone. All other symbols are sent, distinct by row, through a
shuffle to the part of the trie that shares the last two bytes of their context, are
scored there by the same look-ups, and joined back. Words up to ``head_words`` in
number are broadcast, all others are joined by shuffle.

Texts are lower-cased in A-Z first. A text's symbols are its UTF-8 bytes and a
closing byte 0; before its start stand bytes 0. Defined results: a null text is
empty; a null doc_id is a training document; without training documents all
bytes are equally likely; repeated rows are scored each; long texts are scored whole;
other columns of any name are not read; an empty table gives no rows. Words are counted by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, text_or_empty
from reachgrid.llm.words import Table, slices, word_hashes

ORDER = 4
_PART = 250_000
_WORD, _GRAM = 0, 1


@dataclass(frozen=True)
class Limits:
    max_entries: int = 1 << 19
    head_words: int = 1 << 18


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def lowered(texts: list[str]) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() for t in texts]


def grams(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(five bytes up to each symbol as one number, symbols per text)."""
    joined = np.frombuffer(b"".join(b"\0\0\0\0" + x + b"\0" for x in data), dtype=np.uint8)
    sizes = np.fromiter((len(x) + 1 for x in data), dtype=np.int64, count=len(data))
    if not len(data):
        return np.zeros(0, np.uint64), sizes
    n = len(joined) - ORDER
    key = np.zeros(n, dtype=np.uint64)
    for i in range(ORDER + 1):
        key = key << np.uint64(8) | joined[i : i + n]
    inside = np.ones(n, dtype=bool)
    ends = np.cumsum(sizes + ORDER)[:-1]
    for back in range(1, ORDER + 1):
        inside[ends - back] = False
    return key[inside], sizes


class _Counts:
    """Sorted keys with counts; merged when many."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        part = np.unique(keys, return_counts=True)
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > 3_000_000 and len(self.parts) > 8:
            self.parts = [self.merged()]
            self.size = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        keys, n = (np.concatenate(x) for x in zip(*self.parts))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.add.reduceat(n, first) if len(keys) else n


def counts(texts: DataFrame) -> DataFrame:
    """kind, key, n over all ``texts``: words by hash, and five-byte grams. Summed per task first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Counts(), _Counts()
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in slices(found):
                data = lowered(found[a:b])
                kept[_WORD].add(word_hashes(data)[0])
                kept[_GRAM].add(grams(data)[0])
        for kind, held in enumerate(kept):
            keys, n = held.merged()
            for i in range(0, len(keys), 50_000):
                k = keys[i : i + 50_000].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), kind, np.int8)), pa.array(k), pa.array(n[i : i + 50_000])], names=["kind", "key", "n"])

    return texts.select("text").mapInArrow(count, "kind byte, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _most_frequent(table: DataFrame, most: int, least: int = 1) -> tuple[DataFrame, int]:
    """Rows of ``table`` (key, n) with the largest counts, at most ``most``, and the least count kept."""
    top = 100_000
    bins = table.groupBy(F.least("n", F.lit(top)).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(top).collect()
    kept, bound = 0, top + 1
    for row in bins:
        if kept + row["rows"] > most:
            break
        kept, bound = kept + row["rows"], row["n"]
    else:
        bound = 1  # nothing is left out
    bound = max(bound, least)
    return table.where(F.col("n") >= bound), bound


def _arrays(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    found = table.select("key", "n").toArrow()
    keys, n = found["key"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.float64)
    order = np.argsort(keys)
    return keys[order], n[order]


def _level(gram_counts: DataFrame, order: int) -> DataFrame:
    if order == ORDER:
        return gram_counts
    key = F.col("key").bitwiseAND((1 << 8 * (order + 1)) - 1)
    return gram_counts.groupBy(key.alias("key")).agg(F.sum("n").alias("n"))


def trie(gram_counts: DataFrame, limits: Limits = Limits()) -> tuple[list[tuple[np.ndarray, np.ndarray]], bool]:
    """(per order 0 to 4: keys (context and symbol) and counts of the head, whether that is the whole trie).

    Orders 0 and 1 have at most 65,792 entries and are whole.
    """
    levels, least = [], 0
    for order in range(ORDER + 1):
        table = _level(gram_counts, order)
        if order > 1:
            table = table.withColumn("context", F.shiftright("key", 8))
            # Classes of a context's total, finer than 5 %.
            contexts = table.groupBy("context").agg(F.floor(16 * F.log2(F.sum("n"))).alias("class"), F.count("*").alias("entries"))
            kept = 0
            for row in contexts.groupBy("class").agg(F.sum("entries").alias("entries")).orderBy(F.desc("class")).collect():
                kept += row["entries"]
                if kept > limits.max_entries:
                    # Not below the shorter order's bound: a suffix's total is no smaller, so it is there too.
                    least = max(least, row["class"] + 1)
                    break
            if least:
                # At most ``max_entries`` contexts.
                table = table.join(F.broadcast(contexts.where(F.col("class") >= least).select("context")), "context")
        levels.append(_arrays(table))
    return levels, not least


class Model:
    """Code lengths of a fixed trie with full exclusion."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.pairs, self.contexts = [], []
        below = None
        for keys, n in levels:
            own = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(own)))
            group = np.repeat(np.arange(len(first)), sizes)
            total = np.add.reduceat(n, first) if len(first) else n
            whole = np.log10(total + sizes)
            log = np.log10(n)
            pairs = Table(keys, log, log - whole[group])
            escape = np.log10(sizes) - whole
            rest, through = np.zeros(len(first)), np.zeros(len(first))
            if below is not None and len(first):
                # What the next shorter context has left without the symbols of this one.
                bits = np.uint64((1 << 8 * len(self.pairs)) - 1)
                at = below["pairs"].find(keys & bits)
                left = np.bincount(group, weights=below["n"][at], minlength=len(first))
                parent = below["contexts"].find(own[first] & (bits >> np.uint64(8)))
                mass, distinct = below["total"][parent] - left, below["sizes"][parent] - sizes
                open_ = distinct > 0
                rest[open_] = np.log10(mass[open_] + distinct[open_])
                through[open_] = np.log10(distinct[open_]) - rest[open_]
            contexts = Table(own[first], escape, rest, through)
            self.pairs.append(pairs)
            self.contexts.append(contexts)
            below = {"pairs": pairs, "n": n, "contexts": contexts, "total": total, "sizes": sizes}
        self.unseen = -np.log10(max(1, 256 - len(levels[0][0])))

    def symbols(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol, given as the five bytes up to it."""
        out = np.zeros(len(key))
        active, came = np.arange(len(key)), np.full(len(key), -1, dtype=np.int64)
        for order in range(ORDER, -1, -1):
            own = key[active] & np.uint64((1 << 8 * (order + 1)) - 1)
            at = self.pairs[order].find(own)
            hit = at >= 0
            log, direct = self.pairs[order].values
            after = came[hit]
            value = direct.take(at[hit])
            if order < ORDER:
                _, rest, through = self.contexts[order + 1].values
                via = np.flatnonzero(after >= 0)
                value[via] = log[at[hit][via]] - rest[after[via]]
            out[active[hit]] += value
            active, after = active[~hit], came[~hit]
            node = self.contexts[order].find(own[~hit] >> np.uint64(8)).astype(np.int64)
            new = (after < 0) & (node >= 0)
            out[active[new]] += self.contexts[order].values[0][node[new]]
            if order < ORDER:
                via = after >= 0
                out[active[via]] += through[after[via]]
            came = node
            if not len(active):
                return out
        out[active] += self.unseen
        return out

    def holds(self, key: np.ndarray) -> np.ndarray:
        """Whether the longest context of each symbol is there."""
        return self.contexts[ORDER].find(key >> np.uint64(8)) >= 0

    def texts(self, data: list[bytes], whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text without the symbols that a head does not hold, those symbols, their texts)."""
        key, sizes = grams(data)
        row = np.repeat(np.arange(len(data)), sizes)
        known = np.ones(len(key), dtype=bool) if whole else self.holds(key)
        score = np.bincount(row[known], weights=self.symbols(key[known]), minlength=len(data))
        return score, key[~known], row[~known]


def _per_row(keys: np.ndarray, row: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
    """Lists of the distinct keys of rows 0 to n - 1, and how often each is there."""
    order = np.lexsort((keys, row))
    keys, row = keys[order], row[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (row[1:] != row[:-1])])) if len(keys) else np.zeros(0, np.int64)
    often = np.diff(np.append(first, len(keys))).astype(np.int32)
    offsets = pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(keys[first].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(often))


_BUILT: dict = {}


def _built(held) -> tuple:
    """The broadcast as tables, built once in each worker."""
    value = held.value
    if _BUILT.get("of") is not value:
        levels, _, (keys, n) = value
        _BUILT.update({"of": value, "tables": (Model(levels), Table(keys, n))})
    return _BUILT["tables"]


def _merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(keys, return_inverse=True)
    return keys, np.bincount(at, weights=n, minlength=len(keys))


def symbol_scores(keys: DataFrame, gram_counts: DataFrame, held) -> DataFrame:
    """key, value: log10 probability of each distinct ``key`` by the whole trie.

    Contexts that end in the same two bytes meet, at most 2^24 entries by
    construction; such parts are put together by hash to about ``_PART`` entries.
    """
    parts = max(1, -(-gram_counts.count() // _PART))
    part = F.pmod(F.xxhash64(F.shiftright("key", 8).bitwiseAND(0xFFFF)), F.lit(parts)).alias("part")

    def score(counted: pa.Table, wanted: pa.Table) -> pa.Table:
        key = wanted["key"].to_numpy().astype(np.int64)
        if not len(key):
            return pa.table({"key": pa.array(key), "value": pa.array(np.zeros(0))})
        grams_, n = counted["key"].to_numpy().astype(np.int64).view(np.uint64), counted["n"].to_numpy().astype(np.float64)
        longer = [_merged(grams_ & np.uint64((1 << 8 * (order + 1)) - 1), n) for order in range(2, ORDER + 1)]
        return pa.table({"key": pa.array(key), "value": pa.array(Model([*held.value[0][:2], *longer]).symbols(key.view(np.uint64)))})

    known, wanted = gram_counts.select(part, "key", "n"), keys.select("key").distinct().select(part, "key")
    return known.groupBy("part").cogroup(wanted.groupBy("part")).applyInArrow(score, "key long, value double")


def scores(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    train = docs.where(~held_out(F.col("doc_id")))
    table = written(counts(train.select(text_or_empty().alias("text"))), "counts")
    words = table.where(F.col("kind") == _WORD).select("key", "n")
    n_docs = train.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = n_words + n_docs, distinct + (n_docs > 0)
    denominator = float(np.log10(tokens + 0.5 * (kinds + 1)))
    head, bound = _most_frequent(words, limits.head_words)
    gram_counts = table.where(F.col("kind") == _GRAM).select("key", "n")
    levels, whole = trie(gram_counts, limits)
    held = docs.sparkSession.sparkContext.broadcast((levels, whole, _arrays(head)))
    end = float(np.log10(n_docs + 0.5)) - denominator

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = _built(held)
        log = np.log10(known.values[0] + 0.5) - denominator
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in slices(texts):
                data, n = lowered(texts[a:b]), b - a
                hashes, sizes = word_hashes(data)
                row = np.repeat(np.arange(n), sizes)
                at = known.find(hashes)
                hit = at >= 0
                base = np.bincount(row[hit], weights=log[at[hit]], minlength=n) + end
                seen = np.bincount(row[hit], minlength=n) + (n_docs > 0)
                score, missed, where = model.texts(data, whole)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.arange(number, number + n)), batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(sizes + 1), pa.array(seen),
                        pa.array(base), pa.array(score, pa.float64()), *_per_row(hashes[~hit], row[~hit], n), *_per_row(missed, where, n),
                    ],
                    names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "rare", "often", "missed", "times"],
                )
                number += n

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, rare array<long>, often array<int>, missed array<long>, times array<int>"
    rows = written(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text")).mapInArrow(score, schema), "scores")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "often")).alias("_x")).select("row", F.col("_x.rare").alias("key"), F.col("_x.often").alias("often"))
    c = F.coalesce("n", F.lit(0))
    # Only words outside the broadcast ones can match: a small part of the table.
    rare = rare.join(words.where(F.col("n") < bound), "key", "left").groupBy("row").agg(
        F.sum(F.col("often") * (F.log10(c + 0.5) - F.lit(denominator))).alias("_base"), F.sum(F.when(c > 0, F.col("often")).otherwise(0)).alias("_known")
    )
    found, score = rows.drop("rare", "often", "missed", "times").join(rare, "row", "left"), F.col("score")
    if not whole:
        missed = rows.select("row", F.explode(F.arrays_zip("missed", "times")).alias("_x")).select("row", F.col("_x.missed").alias("key"), F.col("_x.times").alias("times"))
        values = symbol_scores(missed, gram_counts, held)
        found = found.join(missed.join(values, "key").groupBy("row").agg(F.sum(F.col("times") * F.col("value")).alias("_score")), "row", "left")
        score = score + F.coalesce("_score", F.lit(0.0))
    return found.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"), score.alias("score"),
    )


def op9_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))
