"""Size statistics of boxes and suggestions for a detector's size range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_geometry


def box_stats(boxes: DataFrame) -> DataFrame:
    """One row: min, max, mean and population deviation of width, height and area; nulls where there is no box."""
    b = with_geometry(boxes)
    aggs = [F.count("*").alias("n")]
    for c, name in (("w", "width"), ("h", "height"), ("area", "area")):
        aggs += [F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"), F.round(F.avg(c), 6).alias(f"{name}_mean"), F.round(F.stddev_pop(c), 6).alias(f"{name}_std")]
    return b.agg(*aggs)


def _top(counts: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k commonest keys (ties: least key) with their rank; a top-k report of k rows."""
    top = counts.orderBy(F.desc("n"), key).limit(k)
    ranked = top.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col(key).alias("k")))).alias("a"))
    return ranked.select(F.posexplode("a").alias("p", "e")).select((F.col("p") + 1).cast("long").alias("rank"), F.col("e.k").alias(key), (-F.col("e.m")).alias("n"))


def common_sizes(boxes: DataFrame, column: str, least: int = 2) -> DataFrame:
    """Five commonest values of a column, of those the ones with more than `least` boxes: limit first."""
    return _top(boxes.groupBy(F.col(column).alias("size")).agg(F.count("*").alias("n")), "size").where(F.col("n") > least)


def _sized(boxes: DataFrame) -> DataFrame:
    """Boxes of 100 < area < 5000, marked as squares within 10 %."""
    return with_geometry(boxes).where("area > 100 and area < 5000").withColumn("is_square", F.expr("aspect_ratio > 0.9D and aspect_ratio < 1.1D"))


def square_stats(boxes: DataFrame) -> DataFrame:
    side = F.expr("(w + h) / 2D")
    return _sized(boxes).where("is_square").agg(F.count("*").alias("n"), F.round(F.avg(side), 6).alias("mean"), F.round(F.stddev_pop(side), 6).alias("std"), F.min(side).alias("least"), F.max(side).alias("most"))


def square_sizes(boxes: DataFrame) -> DataFrame:
    sides = _sized(boxes).where("is_square").select(F.expr("(w + h) div 2").alias("size"))
    return _top(sides.groupBy("size").agg(F.count("*").alias("n")), "size")


def size_buckets(boxes: DataFrame) -> DataFrame:
    """Five commonest 10-pixel buckets of rectangles, of those the ones with more than one box."""
    key = F.expr("concat(cast(w div 10 * 10 as string), 'x', cast(h div 10 * 10 as string))")
    return _top(_sized(boxes).where("not is_square").groupBy(key.alias("bucket")).agg(F.count("*").alias("n")), "bucket").where("n > 1")


def largest(boxes: DataFrame, k: int = 10) -> DataFrame:
    """The k largest boxes over all pages (a top-k report)."""
    return with_geometry(boxes).select("page_id", "box_id", "area").orderBy(F.desc("area"), "page_id", "box_id").limit(k)


def trim_outliers(values: DataFrame, column: str) -> DataFrame:
    """Rows strictly within two population deviations of the mean: none where the deviation is 0."""
    s = values.agg(F.avg(column).alias("m"), F.stddev_pop(column).alias("s"))  # one row
    return values.join(F.broadcast(s)).where(f"abs({column} - m) < 2 * s").drop("m", "s")


def suggest_range(boxes: DataFrame, margin: int = 3) -> DataFrame:
    """Size range of near-squares without outliers, widened by a margin."""
    squares = with_geometry(boxes).where("aspect_ratio > 0.85D and aspect_ratio < 1.15D and area > 50").select(F.expr("(w + h) / 2D").alias("side"))
    out = trim_outliers(squares, "side").agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"), F.round(F.avg("side"), 6).alias("mean"))
    return out.select("n", "lo", "hi", "mean", F.greatest(F.lit(1), (F.col("lo") - margin).cast("int")).cast("long").alias("suggested_min"), (F.col("hi") + margin).cast("int").cast("long").alias("suggested_max"))


def grid_sweep(boxes: DataFrame, lows: list[int], highs: list[int]) -> DataFrame:
    """Counts of near-squares for each pair of area bounds that finds any; best marks the first with most.

    Every box is tested once against the literal grid: no join.
    """
    grid = [(i * len(highs) + j, a, b) for i, a in enumerate(lows) for j, b in enumerate(highs)]
    b = with_geometry(boxes).where("aspect_ratio > 0.8D and aspect_ratio < 1.2D")
    hit = F.filter(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(lo).alias("min_area"), F.lit(hi).alias("max_area")) for k, lo, hi in grid)), lambda g: (F.col("area") > g["min_area"]) & (F.col("area") < g["max_area"]))
    counts = b.select("w", F.explode(hit).alias("g")).groupBy("g.k", "g.min_area", "g.max_area").agg(F.count("*").alias("n"), F.round(F.avg("w"), 6).alias("avg_size"))
    top = counts.agg(F.max_by("k", F.struct(F.col("n"), -F.col("k"))).alias("top"))
    return counts.join(F.broadcast(top)).select(F.col("min_area").cast("long").alias("min_area"), F.col("max_area").cast("long").alias("max_area"), "n", "avg_size", (F.col("k") == F.col("top")).alias("best"))


def broadened(boxes: DataFrame, low: int, high: int, wider: tuple[int, int]) -> DataFrame:
    """Size range and commonest size of boxes with sides in [low, high]; the wider range where none is found."""
    def within(a: int, b: int) -> DataFrame:
        got = boxes.where(f"w between {a} and {b} and h between {a} and {b}")
        n = got.groupBy("w", "h").agg(F.count("*").alias("n"))
        return n.agg(F.sum("n").alias("n"), F.min("w").alias("w_min"), F.max("w").alias("w_max"), F.min("h").alias("h_min"), F.max("h").alias("h_max"), F.max_by(F.struct("w", "h"), F.struct("n", -F.col("w"), -F.col("h"))).alias("mode"))

    first, second = within(low, high).withColumn("pass", F.lit(1)), within(*wider).withColumn("pass", F.lit(2))
    return first.union(second).where("n is not null").orderBy("pass").limit(1).select("n", "w_min", "w_max", "h_min", "h_max", F.col("mode.w").alias("mode_w"), F.col("mode.h").alias("mode_h"), "pass")


def clicked_size(clicks: DataFrame) -> DataFrame:
    """Size and top-left corner from two corner clicks (x0, y0, x1, y1)."""
    return clicks.select("*", F.least("x0", "x1").alias("x"), F.least("y0", "y1").alias("y"), F.abs(F.col("x1") - F.col("x0")).alias("w"), F.abs(F.col("y1") - F.col("y0")).alias("h"))


#: Which boxes each way of measuring looks at.
VARIANTS = {"any": "area > 100", "large": "area > 500", "near_square": "area > 50 and aspect_ratio > 0.85D and aspect_ratio < 1.15D", "equal_sides": "abs(w - h) < 5"}


def variant(boxes: DataFrame, name: str) -> DataFrame:
    return with_geometry(boxes).where(VARIANTS[name])


def config_sizes(boxes: DataFrame, low: int, high: int) -> DataFrame:
    """One row: number, least, greatest and mean sides of the boxes that a detector's side range lets through."""
    aggs = [F.count("*").alias("n")]
    for c in ("w", "h"):
        aggs += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max"), F.round(F.avg(c), 6).alias(f"{c}_mean")]
    return boxes.where(f"w between {low} and {high} and h between {low} and {high}").agg(*aggs)


def suggest_range_by(boxes: DataFrame, key: str, margin: int = 3) -> DataFrame:
    """suggest_range for each value of a column with few values, as dpi: one pass for the deviations, one for the range."""
    squares = variant(boxes, "near_square").select(key, F.expr("(w + h) / 2D").alias("side"))
    stats = squares.groupBy(F.col(key).alias("of")).agg(F.avg("side").alias("m"), F.stddev_pop("side").alias("s"))
    out = squares.join(stats, F.col(key) == F.col("of")).where("abs(side - m) < 2 * s").groupBy(key).agg(F.count("*").alias("n"), F.min("side").alias("lo"), F.max("side").alias("hi"))
    return out.select(key, "n", "lo", "hi", F.greatest(F.lit(1), (F.col("lo") - margin).cast("int")).cast("long").alias("suggested_min"), (F.col("hi") + margin).cast("int").cast("long").alias("suggested_max"))
