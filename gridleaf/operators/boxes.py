"""Operators on detected boxes: filters, overlap removal, order and the wide answer row.

All are keyed by page_id and never cross pages. Greedy, order-dependent steps fold over a
page's sorted array inside the JVM; a page holds at most some hundreds of boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import center_x, center_y, iou_sql, overlap_sql, with_geometry
from ..functions.text import ANSWER_NAMES, answer_columns

OVERLAP, ROW_TOLERANCE = 0.5, 15


def exclusion_bounds(width: int, height: int, top_percent: float = 10, bottom_percent: float = 5) -> list[tuple[int, int, int, int]]:
    """Corner-form regions (x1, y1, x2, y2) at the top and bottom of a page."""
    return [(0, 0, width, int(height * top_percent / 100)), (0, height - int(height * bottom_percent / 100), width, height)]


def excluded(regions: list[tuple[int, int, int, int]]) -> Column:
    """True where the box's centre lies in a region, bounds included."""
    out = F.lit(False)
    for x1, y1, x2, y2 in regions:
        out = out | (center_x().between(x1, x2) & center_y().between(y1, y2))
    return out


def split_excluded(boxes: DataFrame, regions: DataFrame | list) -> tuple[DataFrame, DataFrame]:
    """(kept, excluded). A list of regions becomes a predicate; a table (page_id, x1, y1, x2, y2) joins by page."""
    if isinstance(regions, list):
        return boxes.where(~excluded(regions)), boxes.where(excluded(regions))
    r = regions.select(F.col("page_id").alias("rp"), "x1", "y1", "x2", "y2")
    inside = (F.col("page_id") == F.col("rp")) & center_x().between(F.col("x1"), F.col("x2")) & center_y().between(F.col("y1"), F.col("y2"))
    return boxes.join(r, inside, "left_anti"), boxes.join(r, inside, "left_semi")


def size_filter(boxes: DataFrame, min_area: int = 400, max_area: int = 1600, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Strict bounds on area and aspect ratio."""
    return with_geometry(boxes).where(f"area > {min_area} and area < {max_area} and aspect_ratio > {low}D and aspect_ratio < {high}D")


def overlap_pairs(boxes: DataFrame, rule: Column, threshold: float = OVERLAP) -> DataFrame:
    """(page_id, box_a < box_b, ratio) of pairs of a page over the threshold; rule is over a_ and b_ columns."""
    cols = ("box_id", "x", "y", "w", "h")
    a = boxes.select("page_id", *(F.col(c).alias(f"a_{c}") for c in cols))
    b = boxes.select(F.col("page_id").alias("b_page"), *(F.col(c).alias(f"b_{c}") for c in cols))
    # touching boxes only: ranges in the join condition, before any ratio is computed
    near = "page_id = b_page and a_box_id < b_box_id and a_x < b_x + b_w and b_x < a_x + a_w and a_y < b_y + b_h and b_y < a_y + a_h"
    return a.join(b, F.expr(near)).withColumn("ratio", rule).where(F.col("ratio") > threshold).select("page_id", F.col("a_box_id").alias("box_a"), F.col("b_box_id").alias("box_b"), "ratio")


def _arrays(boxes: DataFrame, first: str, more: str = "") -> DataFrame:
    one = F.expr(f"struct(cast({first} as double) as s, cast(box_id as bigint) as box_id, cast(x as bigint) as x, cast(y as bigint) as y, cast(w as bigint) as w, cast(h as bigint) as h{more})")
    return boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("all"))


def _greedy(threshold: float) -> str:
    """Those of a page's ordered boxes (all) that overlap no box kept before them."""
    return f"aggregate(all, slice(all, 1, 0), (acc, e) -> if(exists(acc, k -> {overlap_sql('k', 'e')} > {threshold}D), acc, concat(acc, array(e))))"


def remove_overlaps(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """Greedy removal by falling fill_score (ties: box_id): page_id, box_id, kept, seq (order of the kept).

    A removed box removes no other, so this is a fold and not an anti-join.
    """
    folded = _arrays(boxes, "-fill_score").select("page_id", "all", F.expr(_greedy(threshold)).alias("kept"))
    each = folded.select("page_id", F.expr("transform(kept, k -> k.box_id)").alias("ids"), F.explode(F.expr("transform(all, b -> b.box_id)")).alias("box_id"))
    at = F.array_position("ids", F.col("box_id"))
    return each.select("page_id", "box_id", (at > 0).alias("kept"), F.when(at > 0, at).alias("seq"))


def without_overlaps(boxes: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """The kept boxes with their columns and seq."""
    kept = remove_overlaps(boxes, threshold).where("kept").select("page_id", "box_id", "seq")
    return boxes.join(kept, ["page_id", "box_id"])


def merge_detections(first: DataFrame, second: DataFrame, threshold: float = OVERLAP) -> DataFrame:
    """All of the first set; of the second, in box_id order, what overlaps nothing so far (IoU over the threshold).

    Where a page has boxes in one set only, they pass untouched.
    """
    both = _arrays(first, "0").withColumnRenamed("all", "one").join(_arrays(second, "1").withColumnRenamed("all", "two"), "page_id", "full")
    step = f"if(exists(acc, k -> {iou_sql('k', 'e')} > {threshold}D), acc, concat(acc, array(e)))"
    out = F.expr(f"case when one is null then two when two is null then one else aggregate(two, one, (acc, e) -> {step}) end")
    return both.select("page_id", F.explode(out).alias("b")).selectExpr("page_id", "b.box_id", "b.x", "b.y", "b.w", "b.h", "b.s = 0 as from_first")


def reading_order(boxes: DataFrame, by_center: bool = True) -> DataFrame:
    """position from 1 by (cy, cx) or (y, x); ties by box_id."""
    keys = [center_y(), center_x()] if by_center else [F.col("y"), F.col("x")]
    return boxes.withColumn("position", F.row_number().over(Window.partitionBy("page_id").orderBy(*keys, "box_id")).cast("long"))


def _rows(source: str, tolerance: int, payload: str, kind: str) -> str:
    """source (y, s, x, payload; in order) as an array (row_num, x, s, payload) in row order."""
    at = f"named_struct('row_num', {{}}, 'x', e.x, 's', cast(size(acc.out) as bigint), '{payload}', e.{payload})"
    return f"""aggregate({source}, named_struct('anchor', cast(null as bigint), 'row', 0L, 'out', cast(array() as array<struct<row_num:bigint,x:bigint,s:bigint,{payload}:{kind}>>)),
      (acc, e) -> if(acc.anchor is null or abs(e.y - acc.anchor) > {tolerance},
        named_struct('anchor', e.y, 'row', acc.row + 1, 'out', concat(acc.out, array({at.format("acc.row + 1")}))),
        named_struct('anchor', acc.anchor, 'row', acc.row, 'out', concat(acc.out, array({at.format("acc.row")})))),
      acc -> array_sort(acc.out))"""


def row_order(boxes: DataFrame, tolerance: int = ROW_TOLERANCE, seq: str = "box_id") -> DataFrame:
    """boxes with row_num and position from 1: rows by an anchor y, x within a row; ties keep y order, then seq.

    A row's anchor is its first y: comparing neighbours instead would chain rows together.
    """
    items = F.expr(f"struct(cast(y as bigint) as y, cast({seq} as bigint) as s, cast(x as bigint) as x, cast(box_id as bigint) as box_id)")
    rows = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(items)).alias("all"))
    placed = rows.select("page_id", F.posexplode(F.expr(_rows("all", tolerance, "box_id", "bigint"))).alias("p", "b")).selectExpr("page_id", "b.box_id", "b.row_num", "cast(p + 1 as bigint) as position")
    return boxes.join(placed, ["page_id", "box_id"])


def row_report(ordered: DataFrame) -> DataFrame:
    """Boxes and floor-mean y of each row."""
    return ordered.groupBy("page_id", "row_num").agg(F.count("*").alias("n_boxes"), F.expr("sum(y) div count(*)").alias("mean_y"))


def wide_answers(ordered: DataFrame) -> DataFrame:
    """One row a page, a boolean column per named answer; boxes beyond the names have no column."""
    at = {name: i + 1 for i, name in enumerate(ANSWER_NAMES)}
    return ordered.groupBy("page_id").agg(*(F.max(F.when(F.col("position") == at[n], F.col("is_filled"))).alias(n) for n in answer_columns()))


def answers(boxes: DataFrame, width: int, height: int, top_percent: float = 10, bottom_percent: float = 5) -> DataFrame:
    """The whole form flow: exclusion, overlap removal, row order, wide row. Excluded boxes remove no other."""
    kept, _ = split_excluded(boxes, exclusion_bounds(width, height, top_percent, bottom_percent))
    return answers_of(kept)


def answers_of(kept: DataFrame, threshold: float = OVERLAP, tolerance: int = ROW_TOLERANCE) -> DataFrame:
    """The wide row of each page's boxes, without overlaps and in row order.

    A page's boxes carry is_filled through both folds, so boxes are shuffled once and joined to nothing.
    """
    pages = _arrays(kept, "-fill_score", ", cast(is_filled as boolean) as is_filled").select("page_id", F.expr(_greedy(threshold)).alias("kept"))
    items = "array_sort(transform(kept, (k, i) -> named_struct('y', k.y, 's', i, 'x', k.x, 'is_filled', k.is_filled)))"
    placed = pages.select("page_id", F.posexplode(F.expr(_rows(items, tolerance, "is_filled", "boolean"))).alias("p", "b"))
    return wide_answers(placed.selectExpr("page_id", "p + 1 as position", "b.is_filled"))


def wide_boxes(ordered: DataFrame, n: int = 0) -> DataFrame:
    """One row a page with the columns box1 to boxn, and further ones up to the most boxes of a page."""
    most = ordered.agg(F.max("position")).first()[0]
    n = max(n, most or 0)
    return ordered.groupBy("page_id").agg(*(F.max(F.when(F.col("position") == i, F.col("is_filled"))).alias(f"box{i}") for i in range(1, n + 1)))


def fill_summary(boxes: DataFrame) -> DataFrame:
    n, filled = F.count("*"), F.count_if("is_filled")
    return boxes.groupBy("page_id").agg(n.alias("total"), filled.alias("filled"), (n - filled).alias("empty"), F.round(filled / n, 6).alias("fill_rate"))
