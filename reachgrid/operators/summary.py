"""Summaries of built graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODES = {"walk": 1, "bike": 2, "car": 4}


def mode_mask_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("mode_mask").agg(F.count("*").alias("edges"))


def mode_coverage(edges: DataFrame) -> DataFrame:
    """mode, edges, ratio of all edges (0.0 without any)."""
    counts = edges.agg(F.count("*").alias("_all"), *[F.count_if(F.col("mode_mask").bitwiseAND(b) != 0).alias(m) for m, b in MODES.items()])
    rows = counts.select("_all", F.inline(F.array(*[F.struct(F.lit(m).alias("mode"), F.col(m).alias("edges")) for m in MODES])))
    return rows.select("mode", "edges", F.when(F.col("_all") > 0, F.col("edges") / F.col("_all")).otherwise(0.0).alias("ratio"))


def graph_summary(before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], ways: DataFrame) -> DataFrame:
    """One row: sizes before and after contraction, mode counts and coverage, tag coverage."""
    from reachgrid.operators.contract import simplify_summary
    from reachgrid.operators.survey import tag_coverage

    nested = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    row = simplify_summary(before, after)
    for df, name in ((mode_mask_counts(after[1]), "mode_masks"), (mode_coverage(after[1]), "modes"), (tag_coverage(ways), "tags")):
        row = row.crossJoin(nested(df, name))  # one row each
    return row
