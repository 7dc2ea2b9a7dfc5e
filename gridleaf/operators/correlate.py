"""Spatial matching of boxes to label texts, page by page.

Candidates come from an equi-join on page_id with the distance as a residual, so a page is
the join key and the pairs of a page are the only pairs. The matches join once: a box gathers
its near texts and its aligned one, and all that follows stays on the partitioning by page.
The greedy exclusive match folds over a page's candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as g
from ..functions.geometry import with_geometry

NEAR, LAYOUT_RADIUS, MATCH_RADIUS, ALIGN_BAND, CLUSTER_EPS = 200, 150, 150, 30, 100
DIRECTIONS = ("right", "left", "below", "above")


def _pairs(boxes: DataFrame, texts: DataFrame, how: str = "inner") -> DataFrame:
    """Box and text of one page, with dx, dy, dist and direction of the text from the box."""
    b = with_geometry(boxes).select("page_id", "box_id", "cx", "cy")
    t = texts.select(F.col("page_id").alias("t_page"), "text_id", F.col("cx").alias("tx"), F.col("cy").alias("ty"))
    dx, dy = F.col("tx") - F.col("cx"), F.col("ty") - F.col("cy")
    return b.join(t, F.col("page_id") == F.col("t_page"), how).drop("t_page").withColumns({"dx": dx, "dy": dy}).withColumns({"dist": g.distance(F.col("dx"), F.col("dy")), "direction": g.direction(F.col("dx"), F.col("dy"))})


def nearest_texts(boxes: DataFrame, texts: DataFrame, radius: float = NEAR) -> DataFrame:
    """All texts within radius of each box, ranked from 1 by distance, then text_id."""
    rank = F.row_number().over(Window.partitionBy("page_id", "box_id").orderBy("dist", "text_id"))
    near = _pairs(boxes, texts).where(F.col("dist") <= radius)
    return near.withColumn("rank", rank.cast("long")).select("page_id", "box_id", "text_id", "dist", "direction", "rank")


def nearest_one(boxes: DataFrame, texts: DataFrame, radius: float = LAYOUT_RADIUS) -> DataFrame:
    best = F.min_by(F.struct("text_id", "dist", "direction"), F.struct("dist", "text_id"))
    near = _pairs(boxes, texts).where(F.col("dist") <= radius)
    return near.groupBy("page_id", "box_id").agg(best.alias("b")).select("page_id", "box_id", "b.text_id", "b.dist", "b.direction")


def _layout_type(has_text: Column) -> Column:
    """The label side of a page from the columns n (boxes with a neighbour) and their count by direction."""
    share = {d: F.col(d) / F.nullif(F.col("n"), F.lit(0)) for d in DIRECTIONS}
    return (
        F.when(~has_text, "unknown").when(share["right"] > 0.7, "right_labels").when(share["left"] > 0.7, "left_labels")
        .when(share["below"] > 0.5, "below_labels").when(share["above"] > 0.5, "above_labels").otherwise("mixed")
    )


def layouts(boxes: DataFrame, texts: DataFrame, radius: float = LAYOUT_RADIUS) -> DataFrame:
    """layout_type and dominant_direction of every page that has boxes.

    Shares are over boxes that have a neighbour; none gives mixed, a page without text unknown.
    """
    near = nearest_one(boxes, texts, radius)
    counts = near.groupBy("page_id").agg(F.count("*").alias("n"), *(F.count_if(F.col("direction") == d).alias(d) for d in DIRECTIONS))
    pages = boxes.groupBy("page_id").agg(F.count("*").alias("n_boxes")).join(texts.select("page_id").distinct().withColumn("has_text", F.lit(True)), "page_id", "left").join(counts, "page_id", "left")
    most = F.greatest(*DIRECTIONS)
    # the mode; ties go to the direction that sorts first
    mode = F.coalesce(*(F.when((F.col(d) == most) & (F.col("n") > 0), d) for d in sorted(DIRECTIONS)))
    return pages.select("page_id", "n_boxes", _layout_type(F.col("has_text").isNotNull()).alias("layout_type"), mode.alias("dominant_direction"))


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each of n points' component under the links a[i] - b[i]."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _cluster_pages(page: np.ndarray, x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Cluster of each box of whole pages (boxes side by side, in box_id order): components of the
    distance graph, numbered in a page by first member; -1 for a box without a neighbour (0 if alone)."""
    n = len(page)
    order = np.lexsort((y, page))
    p, sx, sy = page[order], x[order], y[order]
    live, step, ends = np.arange(n), 1, [np.empty((2, 0), np.int64)]
    while True:  # the neighbour step places further down, while one is in the band of height eps
        live = live[live + step < n]
        live = live[(p[live] == p[live + step]) & (sy[live + step] - sy[live] <= eps)]
        if not len(live):
            break
        close = live[np.hypot(sx[live + step] - sx[live], sy[live + step] - sy[live]) <= eps]
        ends.append(np.stack((order[close], order[close + step])))
        step += 1
    root = _components(n, *np.concatenate(ends, axis=1))
    first = (np.bincount(root, minlength=n) > 1) & (root == np.arange(n))
    begins = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
    sizes = np.diff(np.r_[begins, n])
    number = np.cumsum(first) - np.repeat((np.cumsum(first) - first)[begins], sizes) - 1
    return np.where(np.repeat(sizes, sizes) == 1, 0, np.where(first[root], number[root], -1))


def clusters(boxes: DataFrame, eps: float = CLUSTER_EPS) -> DataFrame:
    """page_id, box_id, cluster: density clusters of two or more boxes are components of dist <= eps.

    A page is a row with its boxes, so an Arrow batch has many pages and numpy works on all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("all")
            box, x, y = lists.flatten().flatten()
            at = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            found = _cluster_pages(at, x.to_numpy(zero_copy_only=False).astype(np.float64), y.to_numpy(zero_copy_only=False).astype(np.float64), eps)
            yield pa.RecordBatch.from_arrays([batch.column("page_id").take(pa.array(at)), box, pa.array(found, pa.int64())], ["page_id", "box_id", "cluster"])

    each = F.struct(F.col("box_id").cast("long").alias("box_id"), "cx", "cy")
    pages = with_geometry(boxes).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(each)).alias("all"))
    return pages.mapInArrow(run, "page_id long, box_id long, cluster long")


_MATCH = ("page_id", "box_id", "text_id", "confidence", "distance", "direction", "alignment")


def _per_box(boxes: DataFrame, texts: DataFrame, radius: float = MATCH_RADIUS, band: int = ALIGN_BAND) -> DataFrame:
    """One row a box: c, its texts in the radius, nearest first; a, its aligned text; side, the direction
    of its nearest text in the layout radius; has_text, if its page has any."""
    flat, down, right = F.abs("dy") < band, F.col("dy") > 0, F.col("dx") > 0
    p = _pairs(boxes, texts, "left")
    p = p.withColumns({"flat": flat, "d": F.when(flat, F.abs("dx")).otherwise(F.abs("dy")).cast("double"), "dir": F.when(flat, F.when(right, "right").otherwise("left")).otherwise(F.when(down, "below").otherwise("above"))})
    aligned = F.when(F.col("flat") | (F.abs("dx") < band), F.struct(~F.col("flat"), F.col("d"), F.col("text_id")))
    return p.groupBy("page_id", "box_id", "cy", "cx").agg(
        F.array_sort(F.collect_list(F.when(F.col("dist") <= radius, F.struct("dist", "text_id", "direction")))).alias("c"), F.min_by(F.struct("text_id", "d", "dir", "flat"), aligned).alias("a"),
        F.min_by("direction", F.when(F.col("dist") <= LAYOUT_RADIUS, F.struct("dist", "text_id"))).alias("side"), F.max(F.col("text_id").isNotNull()).alias("has_text"),
    )


def _aligned() -> dict[str, Column]:
    """Match columns of the aligned text a."""
    none = F.col("a").isNull()
    return {
        "text_id": F.col("a.text_id"), "confidence": F.when(none, 0.0).otherwise(g.alignment_confidence(F.col("a.d"), F.col("a.dir"), F.col("a.flat"))), "distance": F.coalesce("a.d", F.lit(float("inf"))),
        "direction": F.coalesce("a.dir", F.lit("unknown")), "alignment": F.when(none, "none").when(F.col("a.flat"), "horizontal").otherwise("vertical"),
    }


def _taken() -> dict[str, Column]:
    """Match columns of the text m that the box took."""
    none = F.col("m").isNull()
    return {
        "text_id": F.col("m.text_id"), "confidence": F.when(none, 0.0).otherwise(g.proximity_confidence(F.col("m.dist"), F.col("m.direction"))), "distance": F.coalesce("m.dist", F.lit(float("inf"))),
        "direction": F.coalesce("m.direction", F.lit("unknown")), "alignment": F.lit("none"),
    }


#: A page's boxes with m, the text each takes: none, or in order the nearest that no box before it took.
_BARE = "transform(all, e -> named_struct('cy', e.cy, 'cx', e.cx, 'box_id', e.box_id, 'a', e.a, 'm', get(slice(e.c, 1, 0), 0)))"
_EXCLUSIVE = f"""aggregate(all, slice({_BARE}, 1, 0), (acc, e) -> concat(acc, array(named_struct('cy', e.cy, 'cx', e.cx, 'box_id', e.box_id, 'a', e.a,
  'm', get(filter(e.c, t -> not exists(acc, o -> o.m.text_id <=> t.text_id)), 0)))))"""


def align_match(boxes: DataFrame, texts: DataFrame, band: int = ALIGN_BAND) -> DataFrame:
    """Each box's aligned text: same row before same column, then nearest along the axis; texts may repeat."""
    return _per_box(boxes, texts, band=band).select("page_id", "box_id", *(v.alias(k) for k, v in _aligned().items()), "cy", "cx")


def _by_page(per_box: DataFrame, *more: Column) -> DataFrame:
    return per_box.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("cy", "cx", "box_id", "c", "a"))).alias("all"), *more)


def proximity_match(boxes: DataFrame, texts: DataFrame, radius: float = MATCH_RADIUS) -> DataFrame:
    """Exclusive nearest texts: boxes in (cy, cx) order each take their nearest unused text."""
    each = _by_page(_per_box(boxes, texts, radius)).select("page_id", F.explode(F.expr(_EXCLUSIVE)).alias("e")).select("page_id", "e.*")
    return each.select("page_id", "box_id", *(v.alias(k) for k, v in _taken().items()), "cy", "cx")


def post_process(matches: DataFrame) -> DataFrame:
    """A text stays with its most confident box (ties: the first by cy, cx, box_id); losers keep distance and direction."""
    rank = F.row_number().over(Window.partitionBy("page_id", "text_id").orderBy(F.desc("confidence"), "cy", "cx", "box_id"))
    lost = F.col("text_id").isNotNull() & (F.col("r") > 1)
    out = matches.withColumn("r", rank)
    return out.withColumns({"confidence": F.when(lost, 0.0).otherwise(F.col("confidence")), "text_id": F.when(~lost, F.col("text_id"))}).select(*_MATCH)


def adaptive_match(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """Alignment on pages of one label side, exclusive proximity elsewhere; then one box a text.

    One join gives each box all that the layout and both matches need.
    """
    sides = (F.count_if(F.col("side") == d).alias(d) for d in DIRECTIONS)
    pages = _by_page(_per_box(boxes, texts), F.count("side").alias("n"), F.max("has_text").alias("has_text"), *sides)
    pages = pages.select("page_id", "all", _layout_type(F.col("has_text")).isin("right_labels", "left_labels", "below_labels", "above_labels").alias("sided"))
    each = pages.select("page_id", "sided", F.explode(F.expr(f"if(sided, {_BARE}, {_EXCLUSIVE})")).alias("e")).select("page_id", "sided", "e.*")
    near = _taken()
    return post_process(each.select("page_id", "box_id", *(F.when(F.col("sided"), v).otherwise(near[k]).alias(k) for k, v in _aligned().items()), "cy", "cx"))


def survey_items(boxes: DataFrame, texts: DataFrame, matches: DataFrame) -> DataFrame:
    """Items in box_id order with label, confidences and relation; unmatched boxes are named by their id."""
    t = texts.select("page_id", "text_id", "text", F.col("confidence").cast("double").alias("t_conf"))
    b = boxes.select("page_id", "box_id", "is_filled", "x", "y", "w", "h")
    out = matches.join(b, ["page_id", "box_id"]).join(t, ["page_id", "text_id"], "left")
    item = F.row_number().over(Window.partitionBy("page_id").orderBy("box_id")).cast("long") - 1
    return out.select(
        "page_id", item.alias("item_id"), "box_id", "x", "y", "w", "h", "is_filled", F.coalesce("text", F.concat(F.lit("Checkbox "), F.col("box_id").cast("string"))).alias("label"),
        F.coalesce("t_conf", F.lit(0.0)).alias("label_confidence"), F.col("confidence").alias("correlation_confidence"), "distance", "direction",
    )


def survey_metadata(items: DataFrame) -> DataFrame:
    """Per page; a label counts as matched by its text's confidence."""
    n, matched = F.count("*"), F.count_if(F.col("label_confidence") > 0)
    return items.groupBy("page_id").agg(n.alias("total_checkboxes"), matched.alias("matched_labels"), (matched / n).alias("match_rate"), F.avg("correlation_confidence").alias("avg_correlation_confidence"), F.count_if("is_filled").alias("filled"))


def batch_summary(metadata: DataFrame, errors: DataFrame) -> DataFrame:
    """One row over all pages: metadata of the successful, errors (page_id, error) of the others."""
    ok = metadata.agg(F.count("*").alias("successful"), F.coalesce(F.sum("total_checkboxes"), F.lit(0)).alias("total_checkboxes_found"), F.coalesce(F.sum("filled"), F.lit(0)).alias("total_checkboxes_filled"), F.avg("match_rate").alias("average_match_rate"))
    bad = errors.agg(F.count("*").alias("failed"))
    rate = F.coalesce(F.col("total_checkboxes_filled") / F.nullif(F.col("total_checkboxes_found"), F.lit(0)), F.lit(0.0))
    return ok.join(bad).select((F.col("successful") + F.col("failed")).alias("total_files_processed"), "successful", "failed", "total_checkboxes_found", "total_checkboxes_filled", F.round(rate, 6).alias("overall_fill_rate"), F.round("average_match_rate", 6).alias("average_match_rate"))
