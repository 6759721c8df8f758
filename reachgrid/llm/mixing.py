"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue that is served in a shuffled order. A copy of a document
finishes at the virtual time *words its source has served so far, itself
included, divided by the source's target*. All copies of all sources are merged
by finish time and the merge is cut at the total budget, so every source comes
out within one document of its target.

All orders are global sorts by range: rows are dealt to tasks by sampled bounds, each
task sweeps its sorted rows, and one sum per task gives what came before it.

Defined results: a null text has size 0; null sources form one source, last in
the order; documents of size 0 are taken with 0 words; sources of size 0 have
target 0; repeated rows are separate documents, also where all have one doc_id or none; copies that finish at one time go by
epoch, hash, doc_id and size; long texts are counted whole; other columns of any name
are kept by ``mixed_documents`` and not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.shared import written
from reachgrid.llm.common import BROADCAST_ROWS, WORD, documents, left_join_hot

#: How often a document may be repeated, and so the most a source can give.
MAX_EPOCHS = 3
SEED = "mix-1"


def swept(df: DataFrame, order: list[Column], values: list[str]) -> DataFrame:
    """``df``, sorted by range over all partitions, with ``before_<value>``: sums of whole numbers over all rows before."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, so_far = TaskContext.get().partitionId(), [0] * len(values)
        for batch in batches:
            columns = [pa.array(np.full(batch.num_rows, part, np.int32))]
            for i, v in enumerate(values):
                own = batch.column(v).to_numpy(zero_copy_only=False)
                upto = so_far[i] + np.cumsum(own)
                columns.append(pa.array(upto - own))
                so_far[i] = int(upto[-1]) if len(own) else so_far[i]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    names = ["_part", *[f"_in_{v}" for v in values]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    placed = written(placed.mapInArrow(sweep, f"{kinds}, _part int, " + ", ".join(f"{n} long" for n in names[1:])), "swept")
    # One row per task.
    sums = placed.groupBy("_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in values])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_start_{v}") for v in values])
    rows = placed.join(F.broadcast(starts), "_part")
    return rows.select(*df.columns, *[(F.col(f"_start_{v}") + F.col(f"_in_{v}")).alias(f"before_{v}") for v in values])


def size_of(text: str = "text") -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, n_docs, source_size, weight, target: weights 1, 2, 3, ... share all words.

    A target above ``max_epochs`` times its source's size is set to that and the
    excess is shared among the others by weight, until none is above: sources are put in the
    order in which they would be set, and the share of a weight is that of the first that is not.
    """
    sources = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = F.col("source").asc_nulls_last()
    sources = swept(sources.withColumn("one", F.lit(1).cast("long")), [order], ["one"])
    sources = sources.select("source", "n_docs", "source_size", (F.col("before_one") % 3 + 1).alias("weight"))
    ranked = sources.withColumn("cap", max_epochs * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    ranked = written(swept(ranked, [F.col("ratio"), order], ["cap", "weight"]), "sources")
    total, weights = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    share = (F.lit(total) - F.col("before_cap")).cast("double") / (F.lit(weights) - F.col("before_weight"))
    level = ranked.withColumn("share", share).where("ratio >= share").agg(F.min_by("share", F.struct("ratio", "before_weight"))).first()[0] or 0.0
    target = F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))
    return ranked.select("source", "n_docs", "source_size", "weight", target.alias("target"))


def _finish(epoch: int) -> Column:
    return F.when(F.col("target") > 0, (F.col("served") + epoch * F.col("source_size")) / F.col("target")).otherwise(0.0)


def schedule(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> tuple[DataFrame, int]:
    """(rows, budget) of ``sizes`` (row, doc_id, source, size), which must be stored.

    Rows get source_size, target, the shuffle key and ``served``, the words of the source up to and with
    this document in its shuffled order.
    """
    targets = written(source_targets(sizes, max_epochs), "targets")
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    # Sources are joined by a key without nulls.
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    side = written(swept(targets.select(key.alias("_key"), "n_docs", "source_size", "target"), [F.col("_key")], ["source_size"]), "starts")
    rows = sizes.withColumn("_key", key)
    small = side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(side), "_key") if small else left_join_hot(rows, side, "_key", "n_docs")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("shuffle", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    # Source by source; the row's number deals even rows of one doc_id over the tasks.
    rows = swept(rows, [F.col(c) for c in ("_key", "shuffle", "doc_id", "size", "row")], ["size"])
    served = F.col("before_size") + F.col("size") - F.col("before_source_size")
    return rows.withColumn("served", served).drop("before_size", "before_source_size", "n_docs", "_key"), budget


def mix(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """All copies of the rows of ``sizes`` in serving order, cut at the budget.

    row, doc_id, source, size, source_size, target, epoch, finish and ``taken``: the words that the mixture takes
    of the copy, null if the cut lies before it. Sorted by range over all partitions by finish time.
    """
    rows, budget = schedule(sizes, max_epochs, seed)
    each = F.array(*[F.struct(F.lit(k).alias("epoch"), _finish(k).alias("finish")) for k in range(max_epochs)])
    items = rows.withColumn("_copy", F.explode(each)).select("row", "doc_id", "source", "size", "source_size", "target", "shuffle", "_copy.epoch", "_copy.finish")
    items = swept(items, [F.col(c) for c in ("finish", "epoch", "shuffle", "doc_id", "size", "row")], ["size"])
    left = F.lit(budget) - F.col("before_size")
    taken = F.when((left > 0) | (left == 0) & (F.col("size") == 0), F.least("size", left))
    return items.withColumn("taken", taken).drop("before_size", "shuffle")


def _numbered(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` of stored rows of ``docs``, each with its number in ``row``."""
    return written(docs.select(F.monotonically_increasing_id().alias("row"), *columns), "rows")


def mixed_words(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """Per document: size, source_size, target and the words that the mixture takes of it."""
    sizes = _numbered(docs, F.col("doc_id"), F.col("source"), size_of().alias("size"))
    rows = mix(sizes, max_epochs, seed).groupBy("row", "doc_id", "size", "source_size", "target").agg(F.coalesce(F.sum("taken"), F.lit(0)).alias("taken"))
    return rows.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def mixed_documents(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """``docs`` as the mixture has them: a row per copy that is taken whole, same columns.

    The one copy that the budget cuts through is left out.
    """
    held = _numbered(docs, F.struct("*").alias("held"))
    sizes = written(held.select("row", "held.doc_id", "held.source", size_of("held.text").alias("size")), "sizes")
    whole = mix(sizes, max_epochs, seed).where("taken = size").groupBy("row").agg(F.count("*").cast("int").alias("_copies"))
    return held.join(whole, "row").select("held", F.explode(F.sequence(F.lit(1), "_copies"))).select("held.*")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_words(documents(spark, sf_dir))
