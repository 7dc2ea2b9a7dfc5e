"""Fill scores of box interiors: array expressions on pixels, a rule vote on features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the rule vote: feature, threshold, score, confidence; added in this order.
RULES = (("dark_ratio", 0.15, 0.3, 0.2), ("contour_area_ratio", 0.1, 0.25, 0.2), ("cross_pattern_score", 0.3, 0.3, 0.3), ("contour_count", 1, 0.1, 0.1), ("edge_density", 0.05, 0.05, 0.2))
VOTE_THRESHOLD = 0.4
FILL_THRESHOLD = 0.15


def rule_vote(features: DataFrame) -> DataFrame:
    """features with filled_score, confidence and is_filled; doubles added in rule order."""
    score, confidence = F.lit(0.0), F.lit(0.0)
    for name, limit, s, c in RULES:
        score = score + F.when(F.col(name) > limit, s).otherwise(0.0)
        confidence = confidence + F.when(F.col(name) > limit, c).otherwise(0.0)
    out = features.withColumns({"filled_score": score, "confidence": F.least(confidence, F.lit(1.0))})
    return out.withColumn("is_filled", F.col("filled_score") > VOTE_THRESHOLD)


def mean(pixels: Column) -> Column:
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v) / F.nullif(F.size(pixels), F.lit(0))


def variance(pixels: Column) -> Column:
    """Population variance by exact integer sums."""
    n = F.nullif(F.size(pixels), F.lit(0)).cast("long")
    total = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v)
    squares = F.aggregate(pixels, F.lit(0).cast("long"), lambda a, v: a + v * v)
    return (n * squares - total * total).cast("double") / (n * n)


def share_below(pixels: Column, limit: int) -> Column:
    return F.size(F.filter(pixels, lambda v: v < limit)).cast("double") / F.nullif(F.size(pixels), F.lit(0))


def interior(pixels: Column, width: int, height: int) -> Column:
    """Pixels (row by row) inside a margin of max(2, side / 6); empty where nothing is left."""
    m = max(2, min(width, height) // 6)
    at = [r * width + c for r in range(m, height - m) for c in range(m, width - m)]
    return F.transform(F.array(*map(F.lit, at)), lambda i: F.get(pixels, i)) if at else F.expr("cast(array() as array<bigint>)")


def pixel_fill(pixels: Column) -> Column:
    """Score of an interior: dark share, texture and intensity; 0 for an empty one."""
    score = 0.5 * F.least(F.lit(1.0), share_below(pixels, 200) * 5.0) + 0.3 * F.least(F.lit(1.0), variance(pixels) / 1000.0) + 0.2 * F.greatest(F.lit(0.0), 1.0 - mean(pixels) / 255.0)
    return F.when(F.size(pixels) > 0, score).otherwise(0.0)


def pixel_fill_older(pixels: Column, dark: int = 200) -> Column:
    """The older score: dark share and texture."""
    score = 0.7 * share_below(pixels, dark) + 0.3 * F.least(F.lit(1.0), variance(pixels) / 1000.0)
    return F.when(F.size(pixels) > 0, score).otherwise(0.0)
