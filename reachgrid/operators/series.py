"""Statistics of run series, paired comparisons and seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reachgrid.functions.numbering import dense_index
from reachgrid.functions.shared import small_side, written

# Fixed constants of the linear congruential generator.
LCG_FACTOR, LCG_STEP, LCG_SIZE = 1_664_525, 1_013_904_223, 1 << 32


def _checked(df: DataFrame, value: str) -> None:
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    if not df.limit(1).count() or df.where(bad).limit(1).count():
        raise ValueError(f"{value} must be finite numbers, one at least")


def _quantiles(df: DataFrame, by: str, value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and the values at ranks floor((n - 1) q), not interpolated: found in one order of all series, dealt by range."""
    placed = written(dense_index(df.select(by, value), [F.col(by), F.col(value)], "_pos"), "ranked")
    spans = placed.groupBy(by).agg(F.min("_pos").alias("_first"), F.count("*").alias("_n"))
    asked = F.array(*[F.struct(F.lit(name).alias("name"), (F.col("_first") + F.floor((F.col("_n") - 1) * q)).alias("_pos")) for name, q in shares.items()])
    found = placed.drop(by).join(spans.select(by, F.inline(asked)), "_pos")
    return found.groupBy(by).agg(*[F.max(F.when(F.col("name") == name, F.col(value))).alias(name) for name in shares])


def series_summary(df: DataFrame, by: str = "series_id", value: str = "value", check: bool = True) -> DataFrame:
    """count, min, max, mean, p50, p95 and p99 of each series."""
    if check:
        _checked(df, value)
    sums = df.groupBy(by).agg(F.count("*").alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    return sums.join(_quantiles(df, by, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99}), by)


def series_stability(df: DataFrame, by: str = "series_id", value: str = "value", max_relative_mad: float = 0.05) -> DataFrame:
    """Median, median absolute deviation, its share of the median, spread, and whether the series is stable."""
    summary = series_summary(df, by, value)
    deviations = df.join(summary.select(by, F.col("p50").alias("_median")), by).withColumn("_dev", F.abs(F.col(value) - F.col("_median")))
    mad = _quantiles(deviations, by, "_dev", {"mad": 0.5}).join(df.groupBy(by).agg(F.stddev_pop(value).alias("standard_deviation")), by)
    over = lambda a, b: F.when(b != 0, a / F.abs(b)).when(a == 0, 0.0).otherwise(float("inf"))
    rows = summary.join(mad, by).withColumn("relative_mad", over(F.col("mad"), F.col("p50")))
    rows = rows.withColumn("coefficient_of_variation", over(F.col("standard_deviation"), F.col("mean")))
    return rows.withColumn("median", F.col("p50")).withColumn("is_stable", F.col("relative_mad") <= max_relative_mad)


def paired_deltas(baseline: DataFrame, candidate: DataFrame, by: str = "series_id", threshold: float = 0.03, win_ratio: float = 0.7) -> DataFrame:
    """How candidate runs differ from baseline runs of one number, and whether that is faster or slower.

    Runs without a partner and baselines that are not positive are errors.
    """
    _checked(baseline, "value")
    _checked(candidate, "value")
    rows = baseline.select(by, "run", F.col("value").alias("a")).join(candidate.select(by, "run", F.col("value").alias("b")), [by, "run"], "full")
    if rows.where("a is null or b is null or a <= 0").limit(1).count():
        raise ValueError("each run needs a positive baseline and a candidate")
    rows = rows.withColumn("delta", F.col("b") - F.col("a")).withColumn("ratio", F.col("delta") / F.col("a"))
    delta = series_summary(rows, by, "delta", check=False)
    ratio = series_summary(rows, by, "ratio", check=False).select(by, F.col("p50").alias("median_ratio"), F.col("mean").alias("mean_ratio"))
    counts = rows.groupBy(by).agg(F.count("*").alias("runs"), F.count_if(F.col("delta") < 0).alias("faster"), F.count_if(F.col("delta") > 0).alias("slower"), F.count_if(F.col("delta") == 0).alias("unchanged"))
    table = counts.join(delta.select(by, F.col("p50").alias("median_delta"), F.col("mean").alias("mean_delta")), by).join(ratio, by)
    kind = F.when((F.col("faster") / F.col("runs") >= win_ratio) & (F.col("median_ratio") <= -threshold), "faster")
    kind = kind.when((F.col("slower") / F.col("runs") >= win_ratio) & (F.col("median_ratio") >= threshold), "slower").otherwise("inconclusive")
    return table.withColumn("classification", kind)


def drawn_states(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """draw (from 0) and state of the generator after ``draw`` + 1 steps, each by itself.

    So many steps are one affine map again: that of each power of two is known, and a draw goes through those of its bits.
    """
    factor, step, jumps = LCG_FACTOR, LCG_STEP, []
    for _ in range(max(1, n.bit_length() + 1)):
        jumps.append((factor, step))
        factor, step = factor * factor % LCG_SIZE, (factor + 1) * step % LCG_SIZE
    # Products of 32 bits by halves, which stay within 64.
    times = lambda a, x: F.pmod(F.shiftleft(F.pmod(a * F.shiftright(x, 16), F.lit(1 << 16)), 16) + a * x.bitwiseAND(0xFFFF), F.lit(LCG_SIZE))
    state = F.lit(seed % LCG_SIZE).cast("long")
    for bit, (a, c) in enumerate(jumps):
        name = f"_s{bit}"
        # Each bit's map reads the state once.
        before = spark.range(n).select(F.col("id").alias("draw"), state.alias(name)) if not bit else before.select("draw", state.alias(name))  # noqa: F821
        on = F.shiftright(F.col("draw") + 1, bit).bitwiseAND(1) == 1
        state = F.when(on, F.pmod(times(F.lit(a), F.col(name)) + c, F.lit(LCG_SIZE))).otherwise(F.col(name))
    return before.select("draw", state.alias("state"))


def sample_sources(eligible: DataFrame, n_nodes: int, n: int, seed: int = 1337, attempts: int = 64) -> DataFrame:
    """pos, node_index: seeded draws of eligible nodes without repeats, ``attempts`` for each wanted one at most, then the lowest that are left."""
    n = min(n, n_nodes)
    states = drawn_states(eligible.sparkSession, n * attempts, seed)
    drawn = states.groupBy(F.shiftright(F.col("state") * n_nodes, 32).alias("node_index")).agg(F.min("draw").alias("draw"))
    held = eligible.join(small_side(written(drawn, "drawn")), "node_index", "left")
    hits = held.where("draw is not null").select("node_index", F.struct(F.lit(0).alias("late"), F.col("draw").alias("at")).alias("_order"))
    rest = held.where("draw is null").select("node_index", F.struct(F.lit(1).alias("late"), F.col("node_index").alias("at")).alias("_order"))
    some = hits.orderBy("_order").limit(n).unionByName(rest.orderBy("node_index").limit(n)).orderBy("_order").limit(n)
    return some.select((F.row_number().over(Window.orderBy("_order")) - 1).alias("pos"), "node_index")  # at most n rows


def sample_pixels(spark: SparkSession, width: int, height: int, n: int, seed: int = 0x5F3759DF) -> DataFrame:
    """pos, x_px, y_px: seeded pixels, two draws each."""
    pair = drawn_states(spark, 2 * n, seed).groupBy(F.shiftright("draw", 1).alias("pos"))
    at = lambda odd, size: F.shiftright(F.max(F.when(F.col("draw") % 2 == odd, F.col("state"))) * size, 32).cast("int")
    return pair.agg(at(0, width).alias("x_px"), at(1, height).alias("y_px"))


def run_report(runs: DataFrame, by: str = "series_id") -> DataFrame:
    """Settled nodes of runs (``settled``, ``ms``): their summary, the total, and ms per settled node."""
    sums = runs.groupBy(by).agg(F.sum("settled").alias("total_settled"), F.sum("ms").alias("total_ms"))
    per = F.when(F.col("total_settled") > 0, F.col("total_ms") / F.col("total_settled"))
    return series_summary(runs.withColumn("_settled", F.col("settled").cast("double")), by, "_settled").join(sums, by).withColumn("ms_per_settled", per)
