"""From travel times to pixels, bands and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reachgrid.functions.costs import TEMPLATES, band, band_rgb, duration_label
from reachgrid.functions.numbers import half_up

SLACK_S = 0.75

# Fixed texts of the output: a line element, and the note under a legend.
LINE = '<line x1="%s" y1="%s" x2="%s" y2="%s" stroke="rgb(%d, %d, %d)" stroke-width="1" stroke-linecap="round" vector-effect="non-scaling-stroke" />'
NOTE = "Colours repeat every {cycle}."


def visible_segments(field: DataFrame, edges: DataFrame, pixels: DataFrame, slack: float = SLACK_S) -> DataFrame:
    """Segments of edges whose both ends are reached and that the times pass along.

    ``field``: node_index, seconds; ``edges``: edge_index, ends and seconds of the mode;
    ``pixels``: node_index, x_px, y_px.
    """
    at = field.select("node_index", F.col("seconds").alias("t")).join(pixels.select("node_index", "x_px", "y_px"), "node_index")
    end = lambda name, i: at.select(F.col("node_index").alias(f"{name}_index"), F.col("x_px").alias(f"x{i}"), F.col("y_px").alias(f"y{i}"), F.col("t").alias(f"_t{i}"))
    rows = edges.join(end("source", 0), "source_index").join(end("target", 1), "target_index")
    t1 = F.col("_t0") + F.col("seconds")
    return rows.where(t1 <= F.col("_t1") + slack).select("edge_index", "x0", "y0", F.col("_t0").alias("t0"), "x1", "y1", t1.alias("t1"))


def segment_template(field: DataFrame, edges: DataFrame, pixels: DataFrame, slack: float = SLACK_S) -> DataFrame:
    """All edges with their pixels and the times of visible ones, -1 for hidden ones."""
    end = lambda name, i: pixels.select(F.col("node_index").alias(f"{name}_index"), F.col("x_px").alias(f"x{i}"), F.col("y_px").alias(f"y{i}"))
    seen = visible_segments(field, edges, pixels, slack).select("edge_index", "t0", "t1")
    rows = edges.select("edge_index", "source_index", "target_index").join(end("source", 0), "source_index").join(end("target", 1), "target_index").join(seen, "edge_index", "left")
    hidden = lambda c: F.coalesce(c, F.lit(-1.0)).alias(c)
    return rows.select("edge_index", "x0", "y0", hidden("t0"), "x1", "y1", hidden("t1"))


def rasterize(segments: DataFrame, stride: int = 1) -> DataFrame:
    """edge_index, step, x_px, y_px, seconds: pixels of each segment's line, times linear along it.

    The line's minor axis at step k is floor((2 k minor + major) / (2 major)), with whole
    numbers; ``stride`` thins the steps but keeps the last.
    """
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    ax, ay = F.abs(dx), F.abs(dy)
    rows = segments.withColumn("n", F.greatest(ax, ay)).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("n"))))
    rows = rows.where((F.col("step") % stride == 0) | (F.col("step") == F.col("n")))
    k, n = F.col("step"), F.greatest(F.col("n"), F.lit(1))
    # On the longer axis this is k itself.
    along = lambda d, a: F.signum(d.cast("double")).cast("int") * F.floor((2 * k * a + n) / (2 * n))
    x, y = F.col("x0") + along(dx, ax), F.col("y0") + along(dy, ay)
    t = F.col("t0") + (F.col("t1") - F.col("t0")) * F.when(F.col("n") > 0, k / n).otherwise(0.0)
    return rows.select("edge_index", "step", x.cast("int").alias("x_px"), y.cast("int").alias("y_px"), t.alias("seconds"))


def _drawable(rows: DataFrame, width: int, height: int) -> DataFrame:
    t = F.col("seconds")
    inside = F.col("x_px").between(0, width - 1) & F.col("y_px").between(0, height - 1)
    return rows.where(inside & (t >= 0) & (t < float("inf")) & ~F.isnan(t))


def travel_time_raster(field: DataFrame, edges: DataFrame, pixels: DataFrame, width: int, height: int, slack: float = SLACK_S, stride: int = 1) -> DataFrame:
    """x_px, y_px, seconds: least time per pixel over nodes and lines."""
    lines = rasterize(visible_segments(field, edges, pixels, slack), stride).select("x_px", "y_px", "seconds")
    dots = field.join(pixels, "node_index").select("x_px", "y_px", "seconds")
    return _drawable(lines.unionByName(dots), width, height).groupBy("x_px", "y_px").agg(F.min("seconds").alias("seconds"))


def painted_raster(field: DataFrame, edges: DataFrame, pixels: DataFrame, width: int, height: int, cycle: float = 75, theme: str = "dark", slack: float = SLACK_S) -> DataFrame:
    """x_px, y_px, r, g, b when the last painter wins: lines by edge and step, then nodes by index."""
    order = F.struct(F.lit(0).alias("layer"), F.col("edge_index").alias("item"), F.col("step").cast("long").alias("step"))
    lines = rasterize(visible_segments(field, edges, pixels, slack)).select("x_px", "y_px", "seconds", order.alias("order"))
    order = F.struct(F.lit(1).alias("layer"), F.col("node_index").alias("item"), F.lit(0).cast("long").alias("step"))
    dots = field.join(pixels, "node_index").select("x_px", "y_px", "seconds", order.alias("order"))
    rows = _drawable(lines.unionByName(dots), width, height).groupBy("x_px", "y_px").agg(F.max_by("seconds", "order").alias("seconds"))
    return rows.select("x_px", "y_px", band_rgb(band(F.col("seconds"), cycle), theme).alias("c")).select("x_px", "y_px", "c.*")


def banded(raster: DataFrame, cycle: float = 75, theme: str = "dark") -> DataFrame:
    """``raster`` with band and colour."""
    rows = raster.withColumn("band", band(F.col("seconds"), cycle))
    return rows.withColumn("_c", band_rgb(F.col("band"), theme)).select(*raster.columns, "band", "_c.*")


def legend(cycles: DataFrame, theme: str = "dark", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Five rows per cycle (``cycle_minutes``): band, label, colour, and the repeat note."""
    i, cycle = F.col("band"), F.col("cycle_minutes")
    rows = cycles.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(4))))
    label = F.concat(duration_label(cycle * (i / 5), templates), F.lit("–"), duration_label(cycle * ((i + 1) / 5), templates))
    note = F.replace(F.lit(NOTE), F.lit("{cycle}"), duration_label(cycle, templates))
    return rows.select("cycle_minutes", "band", label.alias("label"), note.alias("note"), band_rgb(i, theme).alias("c")).select("cycle_minutes", "band", "label", "note", "c.*")


def raster_diff(a: DataFrame, b: DataFrame, samples: DataFrame | None = None, threshold: int = 64) -> DataFrame:
    """Mean and largest channel difference of two colour rasters, and channels over ``threshold``; no pixel counts as 0."""
    keys = ["x_px", "y_px"]
    both = a.select(*keys, F.array("r", "g", "b").alias("p")).join(b.select(*keys, F.array("r", "g", "b").alias("q")), keys, "full")
    if samples is not None:
        both = samples.select(*keys).distinct().join(both, keys, "left")
    none = F.array(*[F.lit(0)] * 3)
    deltas = F.zip_with(F.coalesce("p", none), F.coalesce("q", none), lambda x, y: F.abs(x - y))
    rows = both.select(F.explode(deltas).alias("d"))
    return rows.agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("mean_delta"), F.coalesce(F.max("d"), F.lit(0)).alias("max_delta"), F.count_if(F.col("d") > threshold).alias("over_threshold"))


def _svg_number(c: Column) -> Column:
    """Two decimals at most, halves upwards, no trailing zeros."""
    whole = half_up(c * 100)
    text = F.format_string("%d.%02d", F.floor(F.abs(whole) / 100), F.abs(whole) % 100)
    return F.concat(F.when(whole < 0, "-").otherwise(""), F.regexp_replace(text, r"\.?0+$|(?<=\.\d)0$", ""))


def edge_line_markup(segments: DataFrame, cycle: float = 75, theme: str = "dark") -> DataFrame:
    """edge_index, markup: a line element per visible segment, coloured by its mean time."""
    good = (F.col("t0") >= 0) & (F.col("t1") >= 0) & (F.col("t0") < float("inf")) & (F.col("t1") < float("inf"))
    rows = segments.where(good).withColumn("_c", band_rgb(band((F.col("t0") + F.col("t1")) * 0.5, cycle), theme))
    text = F.format_string(
        LINE, *[_svg_number(F.col(c).cast("double")) for c in ("x0", "y0", "x1", "y1")], "_c.r", "_c.g", "_c.b",
    )
    return rows.select("edge_index", text.alias("markup"))
