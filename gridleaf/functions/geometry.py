"""Box geometry as Column expressions. Boxes are x, y, w, h (top-left origin, y down)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the matching rules.
PROXIMITY_SCALE, ALIGN_SCALE = 200.0, 100.0
PREFERRED = ("right", "below")


def center_x(p: str = "") -> Column:
    return F.expr(f"{p}x + {p}w div 2")


def center_y(p: str = "") -> Column:
    return F.expr(f"{p}y + {p}h div 2")


def area(p: str = "") -> Column:
    return F.col(f"{p}w") * F.col(f"{p}h")


def aspect_ratio(p: str = "") -> Column:
    """w / h, 0 for a box without height."""
    return F.when(F.col(f"{p}h") > 0, F.col(f"{p}w").cast("double") / F.nullif(F.col(f"{p}h"), F.lit(0))).otherwise(F.lit(0.0))


def with_geometry(boxes):
    return boxes.withColumns({"cx": center_x(), "cy": center_y(), "area": area(), "aspect_ratio": aspect_ratio()})


def intersection(a: str, b: str) -> Column:
    zero = F.lit(0).cast("long")
    wide = F.greatest(zero, F.least(F.col(f"{a}x") + F.col(f"{a}w"), F.col(f"{b}x") + F.col(f"{b}w")) - F.greatest(f"{a}x", f"{b}x"))
    high = F.greatest(zero, F.least(F.col(f"{a}y") + F.col(f"{a}h"), F.col(f"{b}y") + F.col(f"{b}h")) - F.greatest(f"{a}y", f"{b}y"))
    return wide * high


def overlap_ratio(a: str, b: str) -> Column:
    """Intersection over the smaller area."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b).cast("double") / F.nullif(least, F.lit(0))).otherwise(F.lit(0.0))


def iou(a: str, b: str) -> Column:
    """Intersection over union: not the same rule as overlap_ratio."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b).cast("double") / F.nullif(union, F.lit(0))).otherwise(F.lit(0.0))


#: The two rules between structs a and b inside higher-order SQL functions.
_INTER = (
    "cast(greatest(0L, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0L, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) as double)"
)


def overlap_sql(a: str, b: str) -> str:
    return f"coalesce({_INTER.format(a=a, b=b)} / nullif(least({a}.w * {a}.h, {b}.w * {b}.h), 0L), 0D)"


def iou_sql(a: str, b: str) -> str:
    inter = _INTER.format(a=a, b=b)
    return f"coalesce({inter} / nullif({a}.w * {a}.h + {b}.w * {b}.h - {inter}, 0D), 0D)"


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt((dx * dx + dy * dy).cast("double"))


def direction(dx: Column, dy: Column) -> Column:
    """Where the text lies from the box; ties are vertical, no offset is above."""
    return F.when(F.abs(dx) > F.abs(dy), F.when(dx > 0, "right").otherwise("left")).otherwise(F.when(dy > 0, "below").otherwise("above"))


def proximity_confidence(dist: Column, where: Column) -> Column:
    return F.greatest(F.lit(0.0), 1.0 - dist / PROXIMITY_SCALE) * F.when(where.isin(*PREFERRED), 0.9).otherwise(0.7)


def alignment_confidence(dist: Column, where: Column, horizontal: Column) -> Column:
    base = F.when(horizontal, 0.9).otherwise(0.7)
    return base * F.greatest(F.lit(0.0), 1.0 - dist / ALIGN_SCALE) * F.when(where.isin(*PREFERRED), 0.9).otherwise(0.8)
