"""Near-duplicate classes by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles: how often a shingle
occurs times its inverse document frequency. Frequencies are counted over all
documents per hash class (2**18 classes, as in feature hashing), so the table of
weights has one fixed size and a common passage weighs little at any scale.

Each hash function of improved consistent weighted sampling picks one shingle and
a quantised weight; two documents agree in a pick with the probability of their
weighted Jaccard similarity. Picks are banded; texts that share a band are
candidates and are verified by their exact weighted Jaccard similarity.

Equal texts are one text from the start. Inside a band each text is first held
against a few pivots only. Links found so are joined to classes, and only texts
of one band that are still in different classes are compared further: with more
pivots while that joins many, then with all. So a large group of near copies costs
its size, not its square, and yet no link between candidates of different
classes is lost. No cap applies anywhere.

Defined results: texts of fewer than five words have one shingle, all their
words; texts without words are near only to equal texts; a null text is the empty
text; null doc_ids and repeated rows are rows of their own that share a class; a similarity
of the threshold is a link; long texts are compared whole; other columns of any name are
kept by ``kept_documents``; an empty table gives no rows. ``links`` of a text counts the
links that were verified on the way to its class, at least one where it has one: links
inside a class that pivots have joined already are not sought, so it is no degree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, hot_rows, left_join_hot, text_or_empty
from reachgrid.llm.words import MULTIPLIER, mixed, slices, word_hashes

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 10
ROWS = 4
SEED = 20_260
#: Texts of a band that all others of it are held against in one turn.
PIVOTS = 2
#: Texts of one block, when texts of a band are held against all others of it.
BLOCK = 256
#: Texts of one band that meet in one task, about; at most so many bands are dealt out further.
SPREAD, MOST_SPREAD = 256, 100_000

CLASS_BITS = 18
_TABLE_BITS = 15


def shingle_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of texts in their order, ends of each text's among them, from 0 on)."""
    words, sizes = word_hashes([t.encode("utf-8", "surrogatepass") for t in texts])
    total = len(words)
    pad = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    # A rolling polynomial over five words; short texts are covered below.
    value = np.zeros(total, np.uint64)
    for i in range(SHINGLE):
        value = value * MULTIPLIER + pad[i : i + total]
    value = mixed(value)
    first = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(first, sizes)
    keep = place <= np.repeat(np.maximum(sizes - SHINGLE, 0), sizes)
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)).tolist():
        own = sizes[i : i + 1].astype(np.uint64)
        for w in words[first[i] : first[i] + sizes[i]]:
            own = mixed(own * MULTIPLIER + w)
        value[first[i]] = own[0]
        keep[first[i] + 1 : first[i] + sizes[i]] = False
    ends = np.concatenate([[0], np.cumsum(np.where(sizes < SHINGLE, sizes > 0, sizes - SHINGLE + 1))])
    return value[keep], ends


def _sorted_within(value: np.ndarray, ends: np.ndarray) -> np.ndarray:
    cuts = ends.tolist()
    for a, b in zip(cuts, cuts[1:]):
        value[a:b].sort()
    return value


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, how often) of the distinct shingles of texts, sorted by both."""
    value, ends = shingle_hashes(texts)
    value = _sorted_within(value, ends)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], value[at], np.diff(np.append(at, len(value)))


def occurrences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(one key for each occurrence of each shingle, sorted within texts, ends of each text's from 0 on).

    The second, third, ... occurrence of a shingle gets keys of its own in the same hash class, so that
    texts as plain sets of keys have the weighted Jaccard similarity of their shingle counts.
    """
    value, ends = shingle_hashes(texts)
    value = _sorted_within(value, ends)
    again = np.zeros(len(value), dtype=bool)
    again[1:] = value[1:] == value[:-1]
    again[ends[:-1][ends[:-1] < len(value)]] = False
    if again.any():
        start = np.flatnonzero(~again)
        number = np.arange(len(value)) - np.repeat(start, np.diff(np.append(start, len(value))))
        value = value ^ np.where(number > 0, mixed(number.astype(np.uint64)) >> np.uint64(CLASS_BITS), np.uint64(0))
        value = _sorted_within(value, ends)
    return value, ends


def _class_of(value: np.ndarray) -> np.ndarray:
    return (value >> np.uint64(64 - CLASS_BITS)).astype(np.int64)


def class_frequencies(texts: DataFrame) -> DataFrame:
    """_class, n: how many of ``texts`` have a shingle of the hash class. At most 2**18 rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << CLASS_BITS, dtype=np.int64)
        for batch in batches:
            found = batch.column(0).to_pylist()
            for a, b in slices(found):
                value, ends = shingle_hashes(found[a:b])
                group, cuts = _class_of(value), ends.tolist()
                for i, j in zip(cuts, cuts[1:]):
                    # A class that a text has several times is raised once.
                    n[group[i:j]] += 1
        some = np.flatnonzero(n)
        for i in range(0, len(some), 50_000):
            part = some[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(n[part])], names=["_class", "n"])

    return texts.select("text").mapInArrow(count, "_class long, n long").groupBy("_class").agg(F.sum("n").alias("n"))


def class_weights(frequencies: DataFrame, texts: int) -> np.ndarray:
    """Inverse document frequency per hash class, 1 + ln(N / n) / ln(classes); its size is fixed by CLASS_BITS.

    The 1 keeps a passage shared by a large group of near copies in the measure:
    it weighs about two thirds of a rare one, not nearly nothing.
    """
    n = np.zeros(1 << CLASS_BITS)
    table = frequencies.toArrow()  # at most 2**18 rows
    n[table["_class"].to_numpy()] = table["n"].to_numpy()
    return (1 + np.log((texts + 1) / (n + 1)) / np.log(1 << CLASS_BITS)).astype(np.float32)


@cache
def _draws(count: int, seed: int) -> tuple[np.ndarray, ...]:
    """Per hash function a table of draws: r and c from Gamma(2, 1), beta from [0, 1)."""
    rng = np.random.default_rng(seed)
    shape = (count, 1 << _TABLE_BITS)
    r = rng.gamma(2.0, size=shape).astype(np.float32)
    c = np.log(rng.gamma(2.0, size=shape)).astype(np.float32)
    beta = rng.random(size=shape).astype(np.float32)
    # Read together: 1/r, beta, r and ln c - r + r * beta, so that ln a is the last less r * t.
    return (1 / r, beta, r, c - r + r * beta)


def picks(row: np.ndarray, value: np.ndarray, weight: np.ndarray, texts: int, count: int, seed: int = SEED) -> np.ndarray:
    """(texts, count) 64-bit picks of improved consistent weighted sampling; texts without shingles get 0.

    Draws of a shingle come from tables of 2**15 entries, by bits of its hash
    that differ with the hash function; the pick with the least ``a`` wins.
    """
    inverse, beta, r, base = _draws(count, seed)
    out = np.zeros((texts, count), dtype=np.uint64)
    if not len(row):
        return out
    start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(start, len(row)))
    group = np.repeat(np.arange(len(start)), sizes)
    who = row[start]
    log = np.log(weight).astype(np.float32)
    shift = np.uint64(64 - _TABLE_BITS)
    factors = np.random.default_rng(seed + 1).integers(0, 2**63, size=count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for j in range(count):
        at = (value * factors[j] >> shift).astype(np.intp)
        t = np.floor(log * inverse[j].take(at) + beta[j].take(at))
        a = base[j].take(at) - r[j].take(at) * t
        least = np.minimum.reduceat(a, start)
        hit = np.flatnonzero(a == least[group])
        # Equal least values: the smallest hash wins, the same in every text.
        sample = mixed(value[hit] + t[hit].astype(np.int64).view(np.uint64) * MULTIPLIER)
        own = group[hit]
        cut = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[who, j] = np.minimum.reduceat(sample, cut)
    return out


def bands(texts: DataFrame, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """text_id, band key: one row per text and band."""
    held = texts.sparkSession.sparkContext.broadcast(weights)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value
        for batch in batches:
            ids, found = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(found):
                row, value, often = shingles(found[a:b])
                picked = picks(row, value, often * idf[_class_of(value)], b - a, bands * rows)
                full = np.unique(row)
                key = np.zeros((len(full), bands), np.uint64)
                for i in range(rows):
                    key = mixed(key * MULTIPLIER + picked[full, i::rows])
                key = mixed(key + np.arange(bands, dtype=np.uint64))
                own = ids.take(pa.array(a + np.repeat(full, bands)))
                yield pa.RecordBatch.from_arrays([own, pa.array(key.ravel().view(np.int64))], names=["text_id", "band"])

    return texts.select("text_id", "text").mapInArrow(sign, "text_id string, band long")


def similarity(x: np.ndarray, y: np.ndarray, idf: np.ndarray) -> float:
    """Weighted Jaccard similarity of two texts' sorted keys; 1 if neither has any."""
    wx, wy = idf[_class_of(x)].astype(np.float64), idf[_class_of(y)].sum(dtype=np.float64)
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    both = wx[y[at] == x].sum()
    return float(both / (wx.sum() + wy - both))


def _lists(column: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    """Rows of a column of lists of hashes."""
    out = []
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        ends, values = part.offsets.to_numpy(), part.values.to_numpy().view(np.uint64)
        out += [values[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]
    return out


def _dealt_join(pairs: DataFrame, side: str, held: DataFrame, keys: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the sorted keys of their text ``side``; texts of ``hot`` (text_id, parts) go to each of their parts."""
    other = "b" if side == "a" else "a"
    one, few = F.lit(1), F.broadcast(hot)
    rows = pairs.join(few.select(F.col("text_id").alias(side), "parts"), side, "left")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64(other, F.lit(11)), F.coalesce("parts", one)).cast("int")).drop("parts")
    texts = held.join(few, "text_id", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", one) - 1)))
    return rows.join(texts.select(F.col("text_id").alias(side), "salt", F.col("keys").alias(keys)), [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, held: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """``pairs`` (a, b: text_ids) whose weighted Jaccard similarity is at least ``threshold``.

    Keys of texts of pairs only are shuffled. A text of more than ``2 * SPREAD`` pairs, as a pivot of a large
    group is, has its pairs dealt into parts of about ``SPREAD`` and its keys sent once to each part.
    """
    broadcast = pairs.sparkSession.sparkContext.broadcast(weights)
    pairs = written(pairs, "pairs")
    # Not more than MOST_SPREAD texts can have so many pairs.
    large = max(2 * SPREAD, 2 * pairs.count() // MOST_SPREAD)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("text_id")).groupBy("text_id").agg(F.count("*").alias("n"))
    hot = written(ends.where(F.col("n") > large).select("text_id", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts")), "hot-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([similarity(x, y, broadcast.value) for x, y in zip(_lists(batch.column("_left")), _lists(batch.column("_right")))], dtype=np.float64)
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)], names=["a", "b", "similarity"])
            yield out.filter(pa.array(found >= threshold))

    both = _dealt_join(_dealt_join(pairs, "a", held, "_left", hot), "b", held, "_right", hot).select("a", "b", "_left", "_right")
    return both.mapInArrow(compare, "a string, b string, similarity double")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root: the least node that each linked node is connected to.

    Every round takes the least root among a node's neighbours, and then the
    root's root. All of it is joins and sums over written tables; roots of nodes with many
    links, and of many nodes, are joined by broadcast, so no hub meets its rows in one task.
    Least roots spread twice as far each round, so ``max_rounds`` is far more than any
    table needs; classes that have not settled by then are an error.
    """
    edges = written(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct(), "edges")
    first = edges.groupBy(F.col("x").alias("node")).agg(F.least(F.col("node"), F.min("y")).alias("root"), F.count("*").alias("degree"))
    roots = written(first, "roots")
    # Degrees stay: without a hub rounds need no plan for hubs.
    hubs = roots.where(F.col("degree") > hot_rows(edges.count())).limit(1).count()
    for _ in range(max_rounds):
        side = roots.select(F.col("node").alias("y"), F.col("root").alias("_near"), "degree")
        near = left_join_hot(edges, side, "y", "degree") if hubs else edges.join(side.drop("degree"), "y")
        near = near.groupBy(F.col("x").alias("node")).agg(F.min("_near").alias("_near"))
        step = written(roots.join(near, "node").select("node", "root", F.least("root", "_near").alias("_new"), "degree"), "nearer")
        if not step.where(F.col("root") != F.col("_new")).limit(1).count():
            # Neighbours have one root, so all of a class do, and its least node is its own.
            return step.select("node", "root")
        over = step.where(F.col("node") != F.col("_new")).select(F.col("node").alias("_new"), F.col("_new").alias("_over"))
        over = written(over.join(step.groupBy("_new").agg(F.count("*").alias("n")), "_new"), "roots-over")
        if over.limit(1).count():
            step = left_join_hot(step, over, "_new", "n").select("node", F.least(F.col("_new"), F.coalesce("_over", "_new")).alias("_new"), "degree")
            step = written(step, "roots")
        roots = step.select("node", F.col("_new").alias("root"), "degree")
    raise RuntimeError(f"classes did not settle in {max_rounds} rounds")


def classes(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """text_id, root, links: each distinct text of ``docs``, its class and its number of verified links.

    ``text_id`` is the text's MD5; ``root`` the least of its class.
    """
    texts = docs.select("doc_id", F.md5(text_or_empty().cast("binary")).alias("text_id"), text_or_empty().alias("text"))
    weights = class_weights(class_frequencies(texts), docs.count())
    # Equal texts have equal bands: one row for each text stays.
    banded = written(bands(texts, weights, n_bands, n_rows).distinct(), "bands")
    members = written(_members(banded), "members")
    held = _one_of_each(texts, members.select("text_id").distinct())
    links = written(verified(_with_pivots(members, members, 0), held, weights, threshold), "links")
    links, roots = _all_links(members, links, held, weights, threshold)
    counts = links.select("a").union(links.select("b")).groupBy(F.col("a").alias("node")).agg(F.count("*").alias("links"))
    return roots.join(counts, "node", "left").select(F.col("node").alias("text_id"), "root", "links")


def _members(banded: DataFrame) -> DataFrame:
    """band, salt, parts, text_id of bands with several texts; a large band is dealt into ``parts`` by ``salt``."""
    shared = written(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    # Not more than MOST_SPREAD bands can be that large.
    large = max(2 * SPREAD, banded.count() // MOST_SPREAD)
    hot = shared.where(F.col("n") > large).select("band", F.ceil(F.col("n") / SPREAD).cast("int").alias("parts"))
    rows = banded.join(F.broadcast(hot), "band", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("text_id", F.lit(7)), F.col("parts")).cast("int"))
    parts = F.when(F.col("n") > large, F.ceil(F.col("n") / SPREAD)).otherwise(1).cast("int")
    return _per_band(rows, shared.select("band", parts.alias("parts")))


def _per_band(rows: DataFrame, side: DataFrame) -> DataFrame:
    """``rows`` (band, salt, ...) with the columns of ``side`` (band, parts, ...: one row a band), which goes to each part of its band."""
    side = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.join(side.drop("parts"), ["band", "salt"])


def _one_of_each(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """text_id and sorted keys, once for each wanted text.

    The row is named by text and doc_id, so that copies of one text do not meet
    in one task; rows repeated in both are reduced before that.
    """
    one = texts.groupBy("text_id").agg(F.min("doc_id").alias("_doc")).join(wanted, "text_id", "left_semi")
    same = (F.col("a.text_id") == F.col("b.text_id")) & F.col("a.doc_id").eqNullSafe(F.col("b._doc"))
    rows = texts.alias("a").join(one.alias("b"), same, "left_semi").select("text_id", "text").dropDuplicates(["text_id"])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            for a, b in slices(found):
                value, ends = occurrences(found[a:b])
                made = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), made], names=["text_id", "keys"])

    return written(rows.mapInArrow(keys, "text_id string, keys array<long>"), "candidate-texts")


def _with_pivots(rows: DataFrame, among: DataFrame, turn: int, pivots: int = PIVOTS) -> DataFrame:
    """Pairs of each text of ``rows`` with its band's pivots: texts of ``among`` with the least hashes of this turn."""
    least = [F.min(F.struct(F.xxhash64("text_id", F.lit(turn * pivots + i)), "text_id")).alias(f"p{i}") for i in range(pivots)]
    found = among.groupBy("band", "parts").agg(*least)
    found = found.select("band", "parts", F.array_distinct(F.array(*[F.col(f"p{i}.text_id") for i in range(pivots)])).alias("_pivots"))
    pairs = _per_band(rows.select("band", "salt", "text_id"), found).select("text_id", F.explode("_pivots").alias("pivot")).where("text_id != pivot")
    return pairs.select(F.least("text_id", "pivot").alias("a"), F.greatest("text_id", "pivot").alias("b")).distinct()


def _all_links(members: DataFrame, links: DataFrame, held: DataFrame, weights: np.ndarray, threshold: float, turns: int = 4) -> tuple[DataFrame, DataFrame]:
    """(``links`` and those that still join two classes of one band, the roots that all of them give).

    While that joins many, texts outside their band's largest class are held against
    further pivots of it. Texts left outside are then held against all texts of their
    bands in other classes, block by block.
    """
    size = members.count()
    before = None
    for turn in range(1, turns + 1):
        roots = components(links)
        placed = members.join(roots.select(F.col("node").alias("text_id"), "root"), "text_id", "left")
        placed = written(placed.select("band", "salt", "parts", "text_id", F.coalesce("root", "text_id").alias("root")), "placed")
        per = placed.groupBy("band", "parts", "root").agg(F.count("*").alias("n"))
        top = per.groupBy("band", "parts").agg(F.max(F.struct("n", "root")).alias("_top"), F.sum("n").alias("n"), F.count("*").alias("classes")).where("classes > 1")
        top = written(top.select("band", "parts", F.col("_top.root").alias("top"), "n", F.col("_top.n").alias("n_top")), "open-bands")
        left = top.agg(F.sum(F.col("n") * (F.col("n") - F.col("n_top")))).first()[0] or 0
        if not left:
            return links, roots
        rows = _per_band(placed, top)
        if left <= size or turn == turns or before is not None and left > 0.7 * before:
            links = links.union(_block_links(written(rows, "open-members"), held, weights, threshold)).distinct()
            return links, components(links)
        before = left
        pairs = _with_pivots(rows.where("root != top"), rows.where("root = top"), turn)
        links = written(links.union(verified(pairs, held, weights, threshold)).distinct(), "links")
    return links, components(links)


def _block_links(rows: DataFrame, held: DataFrame, weights: np.ndarray, threshold: float) -> DataFrame:
    """Links between texts of different classes that share a band, one of them outside its largest class.

    A band's texts and those outside are dealt into blocks of about ``BLOCK`` texts, and
    each pair of blocks is one group, whatever the band's size. A pair is compared in
    the least of the bands that it shares.
    """
    bands_of = rows.groupBy("text_id").agg(F.sort_array(F.collect_list("band")).alias("bands"))
    texts = held.join(bands_of, "text_id")
    rows = rows.select("band", "text_id", "root", "top", F.ceil(F.col("n") / BLOCK).cast("int").alias("_all"), F.ceil((F.col("n") - F.col("n_top")) / BLOCK).cast("int").alias("_out"))
    rows = rows.join(texts, "text_id")
    own = lambda n, seed: F.pmod(F.xxhash64("text_id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # Both sides come from one table: own names keep their columns apart.
    data = [F.col(c).alias(c) for c in ("text_id", "root", "top", "keys", "bands")]
    band = F.col("band").alias("band")
    outside = rows.where("root != top").select(band, own("_out", 1).alias("i"), every("_all").alias("j"), *data)
    inside = rows.select(band, every("_out").alias("i"), own("_all", 2).alias("j"), *data)
    broadcast = rows.sparkSession.sparkContext.broadcast(weights)

    def compare(key: tuple, x: pa.Table, y: pa.Table) -> pa.Table:
        one, two, top = (np.array(c.to_pylist(), dtype=object) for c in (x["text_id"], y["text_id"], y["top"]))
        root = np.array(y["root"].to_pylist(), dtype=object)
        wanted = np.array(x["root"].to_pylist(), dtype=object)[:, None] != root[None, :]
        # Two texts that are both outside meet twice.
        wanted &= (root == top)[None, :] | (one[:, None] < two[None, :])
        if wanted.any():
            wanted &= _least_shared(_lists(x["bands"]), _lists(y["bands"])) == key[0].as_py()
        i, j, found = near_pairs(_lists(x["keys"]), _lists(y["keys"]), wanted, broadcast.value, threshold)
        a, b = one[i], two[j]
        return pa.table({"a": pa.array(np.where(a < b, a, b), pa.string()), "b": pa.array(np.where(a < b, b, a), pa.string()), "similarity": pa.array(found)})

    both = outside.groupBy("band", "i", "j").cogroup(inside.groupBy("band", "i", "j"))
    return written(both.applyInArrow(compare, "a string, b string, similarity double"), "links")


def near_pairs(x: list[np.ndarray], y: list[np.ndarray], wanted: np.ndarray, idf: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, similarities) of the ``wanted`` pairs of texts at ``threshold`` or above.

    Pairs whose weights alone keep them apart are left out; what the others share is summed
    over an index of the keys of ``y``, so that work goes with the keys that pairs share.
    """
    weights = lambda keys: idf[_class_of(keys)].astype(np.float64)
    wx, wy = (np.array([weights(k).sum() for k in side]) for side in (x, y))
    wanted = wanted & (np.minimum(wx[:, None], wy[None, :]) >= threshold * np.maximum(wx[:, None], wy[None, :]))
    rows, columns = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    if len(rows):
        keys = np.concatenate([y[j] for j in columns.tolist()])
        order = np.argsort(keys, kind="stable")
        keys, owner = keys[order], np.repeat(np.arange(len(columns)), [len(y[j]) for j in columns.tolist()])[order]
        for i in rows.tolist():
            first, last = np.searchsorted(keys, x[i]), np.searchsorted(keys, x[i], side="right")
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(owner[at], weights=np.repeat(weights(x[i]), n), minlength=len(columns))
            whole = wx[i] + wy[columns] - both
            share = np.where(whole > 0, both / np.where(whole > 0, whole, 1), 1.0)
            good = np.flatnonzero(wanted[i, columns] & (share >= threshold))
            out.append((np.full(len(good), i), columns[good], share[good]))
    i, j, found = (np.concatenate(c) for c in zip(*out))
    return i, j, found


def _least_shared(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Least number that each list of ``x`` shares with each of ``y``; the largest number if none."""
    x, y = ([held.view(np.int64) for held in side] for side in (x, y))
    top = np.iinfo(np.int64).max
    out = np.full((len(x), len(y)), top)
    width = max(map(len, y), default=0)
    table = np.full((len(y), width), top)
    for k, held in enumerate(y):
        table[k, : len(held)] = held
    for k, held in enumerate(x):
        out[k] = np.where(np.isin(table, held), table, top).min(axis=1, initial=top)
    return out


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, n_bands: int = BANDS, n_rows: int = ROWS) -> DataFrame:
    """doc_id, class_id, copies, links per row of ``docs``.

    ``class_id`` is the least doc_id of the class (null only if all are null),
    ``copies`` the rows with the same text, ``links`` the other texts found near.
    """
    found = classes(docs, threshold, n_bands, n_rows)
    rows = written(docs.select("doc_id", F.md5(text_or_empty().cast("binary")).alias("text_id")), "rows")
    per_text = rows.groupBy("text_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    per_text = per_text.join(found, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    per_text = written(per_text.withColumn("links", F.coalesce("links", F.lit(0)).cast("long")), "texts")
    per_class = per_text.groupBy("root").agg(F.min("least").alias("class_id"), F.count("*").alias("n"))
    table = written(left_join_hot(per_text, per_class, "root", "n").select("text_id", "class_id", "copies", "links"), "classes")
    return left_join_hot(rows, table, "text_id", "copies").select("doc_id", "class_id", "copies", "links")


def kept_documents(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id, same columns."""
    found = classes(docs, **options)
    key = F.md5(text_or_empty().cast("binary"))
    rows = written(docs.select(F.col("doc_id").alias("_id"), key.alias("text_id")), "rows")
    per_text = rows.groupBy("text_id").agg(F.min("_id").alias("_id"), F.count("*").alias("n"))
    per_text = per_text.join(found, "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))
    best = per_text.groupBy("root").agg(F.min(F.struct("_id", "text_id")).alias("_best")).select("_best.*")
    best = written(best, "kept")
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("_doc"), key.alias("_text"))
    kept = held.join(best, (F.col("_text") == F.col("text_id")) & F.col("_doc").eqNullSafe(F.col("_id")), "left_semi")
    # Rows repeated in doc_id and text: one of them stays.
    repeated = rows.groupBy("_id", "text_id").count().where("count > 1").select("_id", "text_id")
    repeated = written(repeated, "repeated")
    if repeated.limit(1).count():
        same = (F.col("_text") == F.col("text_id")) & F.col("_doc").eqNullSafe(F.col("_id"))
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["_doc", "_text"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select("row.*")


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
