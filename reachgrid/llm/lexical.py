"""Ranked lexical search: variable-block-max WAND over a sharded inverted index.

**Index** (`index`): each task turns its documents into shards of about a million terms. A
shard is one row: its documents with their numbers of terms, its distinct terms sorted by
64-bit hash, and for each term the documents that hold it with its counts. Every row of the
table is in exactly one shard; nothing is shuffled.

**Search** (`search`): statistics of the whole index come first (N, L and, for the terms asked
for, df), then each shard is searched by itself. The most that a posting can add, without
the term's weight, is its impact. For each posting list asked for, dynamic programming chooses
block boundaries that minimise the sum of what the blocks' greatest impacts overstate,
plus a fixed price per block. A query's bound at a document is the sum of the weighted block
maxima of its lists there; it changes only at block ends, so the pivot test of WAND is made once
per stretch between ends, for all stretches at once, and those whose bound is under the
lowest score that still counts are skipped unread. The most promising stretches are read first,
which raises that score; it is carried from shard to shard of a task. A stretch whose bound
equals it is read, since its documents may win by doc_id, so results are exact.

Queries are held by tasks in blocks of `QUERY_BLOCK` items; several blocks are several passes.
Tasks give their best per query, which are merged in two steps.

Defined results: null and empty texts have no terms and are in no result; an item without
terms has none either; repeated rows are separate documents; among equal scores a null
doc_id comes last; long texts are indexed whole, if need be as a shard of their own; other
columns of any name are not read; an empty table gives no rows. Terms are told apart by
64-bit hashes: with 10^10 distinct ones the odds that any of 10^5 asked for meets
another are 1 in 20,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import written
from reachgrid.llm.common import documents, text_or_empty
from reachgrid.llm.words import hashes_at

#: Terms and documents of a shard, at most, unless one document has more.
SHARD_TERMS, SHARD_DOCS = 1_000_000, 20_000
#: Megabytes of a row group of the index, which holds a shard or two, however many a task makes or reads.
GROUP_MB = 8
QUERY_BLOCK = 2_000
#: Postings of a block, at most, and the price of a block in mean distances of impacts from their list's greatest.
BLOCK_MOST, BLOCK_PRICE = 64, 8
#: Postings of the blocks that are looked at first in a shard, in results asked for.
FIRST_LOOK = 4
#: Fixed values of the score, in hundredths.
SCALE, SLOPE = 1_000_000_000, 75

_INSIDE = np.zeros(256, dtype=bool)
_INSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

INDEX = "doc_ids array<long>, sizes array<int>, terms array<long>, df array<int>, posting_docs array<int>, tf array<int>, n_docs long, n_terms long"
_KINDS = [pa.list_(k) for k in (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())] + [pa.int64(), pa.int64()]


def terms_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all terms in a row, number of terms of each text): runs of ASCII letters, digits and all that is not ASCII, A-Z lowered."""
    encoded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join([*encoded, bytes(8)]).translate(_LOWER)
    inside = np.concatenate([[False], _INSIDE[np.frombuffer(data, dtype=np.uint8)[:-8]], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    after = np.cumsum(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)) + 1)
    return hashes_at(data, starts, ends), np.diff(np.searchsorted(starts, after), prepend=0)


def _shard(doc_ids: list[int | None], texts: list[str]) -> list:
    """The columns of one shard."""
    hashes, sizes = [], []
    for a in range(0, len(texts), 500):
        some, n = terms_of(texts[a : a + 500])
        hashes.append(some)
        sizes.append(n)
    term, size = np.concatenate(hashes), np.concatenate(sizes)
    doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
    order = np.argsort(term, kind="stable")
    term, doc = term[order], doc[order]
    new = np.ones(len(term), dtype=bool)
    new[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    tf = np.diff(first, append=len(term)).astype(np.int32)
    term, doc = term[first], doc[first]
    heads = np.flatnonzero(np.diff(term, prepend=~term[:1]) != 0)
    df = np.diff(heads, append=len(term)).astype(np.int32)
    return [doc_ids, size.astype(np.int32), term[heads].view(np.int64), df, doc, tf, int((size > 0).sum()), int(size.sum())]


def index(docs: DataFrame) -> DataFrame:
    """One row per shard of ``docs`` (doc_id, text); write it to search it more than once."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(ids: list[int | None], texts: list[str]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(_shard(ids, texts), _KINDS)], names=names)

        ids, texts, chars = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A term and what parts it from the next take two characters at least, about six in prose.
                if ids and (chars + len(text) > 6 * SHARD_TERMS or len(ids) >= SHARD_DOCS):
                    yield row(ids, texts)
                    ids, texts, chars = [], [], 0
                ids.append(i)
                texts.append(text)
                chars += len(text)
        if ids:
            yield row(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(build, INDEX)


def block_starts(impacts: np.ndarray, lengths: np.ndarray, most: int = BLOCK_MOST, price: float = BLOCK_PRICE) -> np.ndarray:
    """For posting lists that lie side by side: True where a block starts.

    The boundaries minimise, list by list, the sum over blocks of (greatest impact times postings) plus a price per
    block, over all ways to cut the list into blocks of at most ``most`` postings. One step takes the next posting of all lists.
    """
    out = np.zeros(len(impacts), dtype=bool)
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return out
    first = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    first, n = first[order], lengths[order]
    top = np.maximum.reduceat(impacts, np.sort(first))[np.argsort(np.argsort(first))]
    mean = np.add.reduceat(impacts.astype(np.float64), np.sort(first))[np.argsort(np.argsort(first))] / n
    price_of = price * (top - mean) + 1e-9
    # Ring of the last ``most`` starts of each list: cost up to the start, greatest impact since, and the start itself.
    cost = np.full((len(n), most), np.inf)
    peak = np.zeros((len(n), most))
    start = np.zeros((len(n), most))
    best = np.zeros(len(n))
    back = np.zeros(len(impacts), dtype=np.int32)
    active = np.searchsorted(-n, -np.arange(1, n[0] + 1), side="right")  # lists with at least so many postings
    for i in range(int(n[0])):
        m, slot, width = int(active[i]), i % most, min(i + 1, most)
        cost[:m, slot], peak[:m, slot], start[:m, slot] = best[:m], 0, i
        at = first[:m] + i
        np.maximum(peak[:m, :width], impacts[at][:, None], out=peak[:m, :width])
        total = cost[:m, :width] + peak[:m, :width] * (i + 1 - start[:m, :width])
        chosen = np.argmin(total, axis=1)
        rows = np.arange(m)
        best[:m] = total[rows, chosen] + price_of[:m]
        back[at] = start[rows, chosen].astype(np.int32)
    # Back from the ends, all lists at once.
    end = n.copy()
    live = np.arange(len(n))
    while len(live):
        begin = back[first[live] + end[live] - 1]
        out[first[live] + begin] = True
        end[live] = begin
        live = live[begin > 0]
    return out


class Queries:
    """Items with the hashes of their terms: ``items``, and side by side each item's distinct terms as places in ``terms``, with repeats in ``times``."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items = [i for i, _ in items]
        hashes, sizes = terms_of([t for _, t in items])
        pair = np.stack([np.repeat(np.arange(len(items)), sizes), np.zeros(len(hashes), np.int64)], axis=1)
        self.terms, pair[:, 1] = np.unique(hashes, return_inverse=True)
        pair, times = np.unique(pair, axis=0, return_counts=True)
        self.ends = np.searchsorted(pair[:, 0], np.arange(len(items) + 1))
        self.of, self.times = pair[:, 1], times.astype(np.int64)


def document_counts(shards: DataFrame, terms: np.ndarray) -> np.ndarray:
    """df of each of ``terms`` (sorted hashes) over the whole index."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), dtype=np.int64)
        for batch in batches:
            for own, df in zip(batch.column(0), batch.column(1)):
                own, df = own.values.to_numpy().view(np.uint64), df.values.to_numpy()
                at = np.searchsorted(own, terms)
                there = np.flatnonzero(own[np.minimum(at, len(own) - 1)] == terms) if len(own) else []
                total[there] += df[at[there]]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "df"])

    # At most one row per term.
    found = shards.select("terms", "df").mapInArrow(count, "place long, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    out = np.zeros(len(terms), dtype=np.int64)
    for row in found:
        out[row["place"]] = row["df"]
    return out


class Best:
    """The best documents of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.score = [np.zeros(0, dtype=np.int64)] * n
        self.doc = [np.zeros((0, 2), dtype=np.int64)] * n

    def least(self, q: int) -> int:
        """What a score must reach to count."""
        return int(self.score[q][-1]) if len(self.score[q]) >= self.k else 1

    def add(self, q: int, score: np.ndarray, doc: np.ndarray) -> None:
        """``doc``: (1 without an id, id) of each."""
        score, doc = np.concatenate([self.score[q], score]), np.concatenate([self.doc[q], doc])
        order = np.lexsort((doc[:, 1], doc[:, 0], -score))[: self.k]
        self.score[q], self.doc[q] = score[order], doc[order]


def search_shard(shard: tuple[np.ndarray, ...], ids: np.ndarray, queries: Queries, weights: np.ndarray, damping: np.ndarray, best: Best) -> tuple[int, int]:
    """Offer ``best`` what the shard has; (postings asked for, postings read)."""
    terms, df, posting_docs, tf = shard
    at = np.searchsorted(terms, queries.terms)
    there = np.flatnonzero(terms[np.minimum(at, len(terms) - 1)] == queries.terms) if len(terms) else np.zeros(0, np.int64)
    if not len(there):
        return 0, 0
    # The lists asked for, side by side.
    head = np.cumsum(df) - df
    lengths = df[at[there]].astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    take = np.repeat(head[at[there]] - begin, lengths) + np.arange(lengths.sum())
    docs, times = posting_docs[take].astype(np.int64), tf[take].astype(np.int64)
    impacts = SCALE * times // (1000 * times + 8 * damping[docs])
    starts = np.flatnonzero(block_starts(impacts, lengths))
    most = np.maximum.reduceat(impacts, starts)
    ends = np.append(starts[1:], len(docs))
    lows, highs = docs[starts], docs[ends - 1] + 1
    blocks = np.searchsorted(starts, np.append(begin, len(docs)))
    place = np.full(len(queries.terms), -1)
    place[there] = np.arange(len(there))
    asked = read = 0
    for q in range(len(queries.items)):
        span = slice(queries.ends[q], queries.ends[q + 1])
        held = place[queries.of[span]]
        weight = (weights[queries.of[span]] * queries.times[span])[held >= 0]
        held = held[held >= 0]
        if not len(held):
            continue
        tops = np.maximum.reduceat(most, blocks[:-1])[held] * weight
        # Stretches between block ends and the bound of each.
        own = np.concatenate([np.arange(blocks[h], blocks[h + 1]) for h in held])
        bounds = most[own] * np.repeat(weight, blocks[held + 1] - blocks[held])
        cuts, where = np.unique(np.concatenate([lows[own], highs[own]]), return_inverse=True)
        change = np.zeros(len(cuts), dtype=np.int64)
        np.add.at(change, where, np.concatenate([bounds, -bounds]))
        bound, width = np.cumsum(change)[:-1], np.diff(cuts)
        asked += int(lengths[held].sum())
        # The documents of the most promising blocks first, enough for some results; then all that may still count.
        promising = own[np.argsort(-bounds, kind="stable")]
        some = promising[: int(np.searchsorted(np.cumsum(ends[promising] - starts[promising]), FIRST_LOOK * best.k)) + 1]
        seen = np.zeros(cuts[-1] - cuts[0] + 1, dtype=bool)
        for look in (1, 2):
            pivots = np.zeros(len(seen), dtype=bool)
            if look == 1:
                spans = zip(starts[some], ends[some])
            else:
                live = np.repeat(bound >= best.least(q), width)
                # A document that only lists of low bounds hold cannot win, however they add up.
                rising = np.argsort(tops, kind="stable")
                needed = held[rising[np.cumsum(tops[rising]) >= best.least(q)]]
                spans = zip(begin[needed], begin[needed] + lengths[needed])
            for a, b in spans:
                pivots[docs[a:b] - cuts[0]] = True
            if look == 2:
                pivots[:-1] &= live & ~seen[:-1]
            score = np.zeros(len(seen), dtype=np.int64)
            for h, w in zip(held, weight):
                a, b = begin[h], begin[h] + lengths[h]
                inside = np.flatnonzero(pivots[docs[a:b] - cuts[0]])
                read += len(inside)
                score[docs[a + inside] - cuts[0]] += w * impacts[a + inside]
            seen |= pivots
            found = np.flatnonzero(score >= best.least(q))
            best.add(q, score[found], ids[found + cuts[0]])
    return asked, read


def search(shards: DataFrame, items: DataFrame, k: int = 10, block: int = QUERY_BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of an ``index`` (stored) for each row of ``items`` (item_id, text)."""
    spark = shards.sparkSession
    kind = items.schema["item_id"].dataType.simpleString()
    total = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    numbered = dense_index(items.select("item_id", text_or_empty().alias("text")), [F.col("item_id"), F.col("text")], "item")
    last = numbered.agg(F.max("item")).first()[0]
    out = None
    for first in range(0, (-1 if last is None else last) + 1, block):
        some = numbered.where(F.col("item").between(first, first + block - 1)).orderBy("item").collect()
        found = _search_block(shards, Queries([(r["item"], r["text"]) for r in some]), *total, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    # First among the tasks of a part, then among parts.
    for keys in (["item", "part"], ["item"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return out.join(numbered.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def _search_block(shards: DataFrame, queries: Queries, n_docs: int, n_terms: int, k: int) -> DataFrame:
    df = document_counts(shards, queries.terms)
    weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(queries.items), k)
        for batch in batches:
            for row in range(batch.num_rows):
                of = lambda c: batch.column(c)[row].values  # noqa: E731, B023
                sizes, doc_ids = of(1).to_numpy().astype(np.int64), of(0)
                ids = np.stack([doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), doc_ids.fill_null(0).to_numpy()], axis=1)
                damping = 100 - SLOPE + SLOPE * sizes * n_docs // max(1, n_terms)
                shard = (of(2).to_numpy().view(np.uint64), of(3).to_numpy(), of(4).to_numpy(), of(5).to_numpy())
                search_shard(shard, ids, queries, weights, damping, best)
        sizes = [len(s) for s in best.score]
        doc = np.concatenate([*best.doc, np.zeros((0, 2), np.int64)])
        part = TaskContext.get().partitionId() % 256 if TaskContext.get() else 0
        columns = [
            pa.array(np.repeat(np.array(queries.items, np.int64), sizes)), pa.array(np.full(len(doc), part, np.int32)),
            pa.array(doc[:, 1], mask=doc[:, 0] > 0), pa.array(np.concatenate([*best.score, np.zeros(0, np.int64)])),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["item", "part", "doc_id", "score"])

    return shards.select("doc_ids", "sizes", "terms", "df", "posting_docs", "tf").mapInArrow(run, "item long, part int, doc_id long, score long")


def op13_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return search(written(index(documents(spark, sf_dir)), "lexical-index", GROUP_MB), items)


ORACLE_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS u
  FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(u)) AS BIGINT) AS n_terms FROM t WHERE len(u) > 0),
p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, len(u) AS n, unnest(u) AS term FROM t) GROUP BY row, doc_id, n, term),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY item_id, term),
w AS (SELECT item_id, term, times, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN d USING (term), s),
r AS (
  SELECT item_id, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM w JOIN p USING (term), s GROUP BY item_id, doc_id, row)
SELECT * FROM (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM r WHERE score > 0)
WHERE rank <= 10
"""
