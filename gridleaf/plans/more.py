"""Further queries over the driver's tables: page-local pairs, measured image statistics, lists, names and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import clean_name
from ..operators import boxes as bx
from ..operators import mapping as mp
from ..operators import measure as ms
from ..operators import quality as qu
from ..operators import vision as vi
from ..sources import fixtures as fx
from ..sources import sinks
from ..sources.fixtures import BOXES_SQL, RASTERS_SQL, TEXTS_SQL
from . import catalog as c
from .catalog import query, rounded

_GEO = BOXES_SQL


def _page_pairs(rule: str) -> str:
    """Pairs of one page by an equality join, and the order of a pair and the rule in a filter outside of it."""
    both = "select a.page_id, a.box_id as box_a, b.box_id as box_b, a.x as ax, a.y as ay, a.w as aw, a.h as ah, b.x as bx, b.y as by_, b.w as bw, b.h as bh from boxes a join boxes b on a.page_id = b.page_id"
    return f"select page_id, box_a, box_b, round(ratio, 6) as ratio from (select page_id, box_a, box_b, {rule} as ratio from (select *, cast(greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by_ + bh) - greatest(ay, by_)) as double) as inter from ({both})) where box_a < box_b and inter > 0) where ratio > cast(0.5 as double)"


@query("overlap_pairs_on_page", BOXES_SQL, _page_pairs("inter / least(aw * ah, bw * bh)"))
def overlap_pairs_on_page(spark, d):
    return c.overlap_pairs(spark, d)


@query("iou_pairs_on_page", BOXES_SQL, _page_pairs("inter / (aw * ah + bw * bh - inter)"))
def iou_pairs_on_page(spark, d):
    return c.iou_pairs(spark, d)


@query("wide_boxes_every_position", BOXES_SQL, c.rows_sql("boxes", "box_id"), "select * from (pivot (select page_id, 'box' || position as box, is_filled from placed) on box using bool_or(is_filled) group by page_id)")
def wide_boxes_every_position(spark, d):
    """wide_boxes without a least number of columns: its SQL takes them from the data, too."""
    return bx.wide_boxes(bx.row_order(fx.plain_boxes(spark, d)))


# ------------------------------------------------------------------ images

#: The 8 x 8 rasters with the pixels beyond an edge mirrored, so that the second difference of every pixel is defined.
_LAPLACE = """px as (select page_id, r, k, pixels[r * 8 + k + 1] as v, pixels[abs(r - 1) * 8 + k + 1] as up, pixels[(7 - abs(7 - (r + 1))) * 8 + k + 1] as down, pixels[r * 8 + abs(k - 1) + 1] as before, pixels[r * 8 + (7 - abs(7 - (k + 1))) + 1] as after
 from rasters, (select unnest(range(0, 8)) as r), (select unnest(range(0, 8)) as k)),
measured as (select page_id, 8 as width, 8 as height, stddev_pop(v) as contrast, avg(v) as brightness, var_pop(up + down + before + after - 4 * v) as blur_score from px group by page_id),
mscore as (select *, score >= cast(0.6 as double) as valid from (select *, (least(1, width / 1000) + least(1, contrast / 50) + case when brightness between 50 and 200 then 1 else greatest(0, 1 - abs(brightness - 125) / 125) end + least(1, blur_score / 200)) / 4 as score from measured))"""


def _raster_rows(spark, d):
    """The 8 x 8 patches as raster rows of bytes."""
    px = F.transform("pixels", lambda v: F.lpad(F.hex(v), 2, "0"))
    return fx.rasters(spark, d).select("page_id", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), F.unhex(F.concat_ws("", px)).alias("data"))


@query("image_stats", RASTERS_SQL, _LAPLACE, "select page_id, width, height, round(contrast, 6) as contrast, round(brightness, 6) as brightness, round(blur_score * 4096) / 4096 as blur_score from measured")
def image_stats(spark, d):
    return rounded(vi.image_stats(_raster_rows(spark, d)), "contrast", "brightness").withColumn("blur_score", F.round(F.col("blur_score") * 4096) / 4096)


@query("quality_image_measured", RASTERS_SQL, _LAPLACE, "select page_id, width, height, round(contrast, 6) as contrast, round(brightness, 6) as brightness, round(blur_score * 4096) / 4096 as blur_score, round(score, 6) as score, valid from mscore")
def quality_image_measured(spark, d):
    out = qu.image(vi.image_stats(_raster_rows(spark, d))).select("page_id", "width", "height", "contrast", "brightness", "blur_score", "score", "valid")
    return rounded(out, "contrast", "brightness", "score").withColumn("blur_score", F.round(F.col("blur_score") * 4096) / 4096)


_SAID = "'Overall quality grade: ' || grade || ' (score: ' || format('{:.3f}', score) || '). Best performing component: ' || best || ' (' || format('{:.3f}', list_max(s)) || '). Needs improvement: ' || worst || ' (' || format('{:.3f}', list_min(s)) || ').'"


@query("quality_summary", *c._QALL, f"select page_id, regexp_replace({_SAID}, '[0-9]\\.[0-9]{{3}}', 'N', 'g') as summary, round(score, 6) as score from (select *, {c._NAMES}[list_position(s, list_max(s))] as best, {c._NAMES}[list_position(s, list_min(s))] as worst from graded)")
def quality_summary(spark, d):
    """The sentence of each page. Its numbers are compared beside it, as the two engines round halves of binary fractions apart."""
    pages = c._overall(spark, d)
    said = qu.summary(pages).select("page_id", F.regexp_replace("summary", r"[0-9]\.[0-9]{3}", "N").alias("summary"))
    return said.join(pages.select("page_id", F.round("score", 6).alias("score")), "page_id")


# ------------------------------------------------------------------ lists and orders


@query("first_empty_boxes", BOXES_SQL, "select page_id, box_id, n from (select page_id, box_id, row_number() over (partition by page_id order by cy, cx, box_id) as n from geo where not is_filled) where n <= 5")
def first_empty_boxes(spark, d):
    """The first five empty boxes of each page, in order of centres (the feature is this limit)."""
    return bx.reading_order(fx.boxes(spark, d).where("not is_filled")).where("position <= 5").select("page_id", "box_id", F.col("position").alias("n"))


@query("filled_boxes", BOXES_SQL, "select page_id, box_id, fill_score from boxes where is_filled")
def filled_boxes(spark, d):
    return fx.boxes(spark, d).where("is_filled").select("page_id", "box_id", "fill_score")


@query("region_order", TEXTS_SQL, "select page_id, text_id, row_number() over (partition by page_id order by cy, cx, text_id) as position from texts")
def region_order(spark, d):
    """Text regions by the centre's y, then its x."""
    t = fx.texts(spark, d).withColumnRenamed("text_id", "box_id")
    return bx.reading_order(t).select("page_id", F.col("box_id").alias("text_id"), "position")


@query("first_recommendations", *c._QALL, f"select page_id, recommendation, n from (select page_id, recommendation, row_number() over (partition by page_id order by ord) as n from ({c._ADVICE_SQL})) where n <= 3")
def first_recommendations(spark, d):
    """The first three recommendations of each page (the feature is this limit)."""
    lists = c.recommendations(spark, d).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("ord", "recommendation"))).alias("all"))
    few = lists.select("page_id", F.posexplode(F.slice("all", 1, 3)).alias("i", "e"))
    return few.select("page_id", "e.recommendation", (F.col("i") + 1).cast("long").alias("n"))


# ------------------------------------------------------------------ names and exports

_PARTS = "select cast(p_partkey as bigint) as page_id, p_name || ' -x' || p_partkey as name from part"


@query("custom_names", f"select page_id, regexp_replace(translate(name, ' -', '__'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') as name from ({_PARTS})")
def custom_names(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(F.col("p_partkey").cast("long").alias("page_id"), clean_name(F.concat("p_name", F.lit(" -x"), F.col("p_partkey").cast("string"))).alias("name"))


@query("mapping_reference", BOXES_SQL, "select page_id, 'box' || position as box_number, 'q' || position as column_name, x as position_x, y as position_y, is_filled, fill_score from (select *, row_number() over (partition by page_id order by cy, cx, box_id) as position from geo)")
def mapping_reference(spark, d):
    return mp.reference(bx.reading_order(fx.boxes(spark, d)).withColumn("column_name", F.concat(F.lit("q"), F.col("position").cast("string"))))


@query("simple_mapping_json", BOXES_SQL, """select '{' || string_agg('"box' || position || '":"q' || position || '"', ',' order by position) || '}' as json from (select row_number() over (order by cy, cx, box_id) as position from geo where page_id = 1)""")
def simple_mapping_json(spark, d):
    return mp.simple_json(mp.saved_mapping(bx.reading_order(fx.boxes(spark, d).where("page_id = 1"))))


@query("custom_answers", BOXES_SQL, "select page_id, " + ", ".join(f"max(case when position = {i} then cast(is_filled as int) end) = 1 as a{i}" for i in range(1, 9)) + " from (select *, row_number() over (partition by page_id order by cy, cx, box_id) as position from geo) group by page_id")
def custom_answers(spark, d):
    """One row a page with the columns of a list of names, of the first eight boxes here."""
    return mp.custom_wide(bx.reading_order(fx.boxes(spark, d)), [f"a{i}" for i in range(1, 9)])


@query("draw_boxes", BOXES_SQL, "select page_id, 'rectangle' as shape, x, y, w, h, case when is_filled then 'green' else 'red' end as colour, 'box' || (box_id + 1) as label from boxes")
def draw_boxes(spark, d):
    return sinks.draw_boxes(fx.boxes(spark, d))


@query("draw_excluded", BOXES_SQL, f"select page_id, 'rectangle' as shape, x, y, w, h, case when {c._EXCLUDED} then 'red' else 'green' end as colour, case when {c._EXCLUDED} then 'excluded' else 'kept' end as label from geo")
def draw_excluded(spark, d):
    return sinks.draw_excluded(*bx.split_excluded(fx.boxes(spark, d), bx.exclusion_bounds(c.W, c.H)))


@query("draw_measured", BOXES_SQL, "select page_id, 'rectangle' as shape, x, y, w, h, 'blue' as colour, w || 'x' || h as label from (select *, row_number() over (partition by page_id order by area desc, box_id) as n from geo) where n <= 50")
def draw_measured(spark, d):
    return sinks.draw_measured(fx.boxes(spark, d))


# ------------------------------------------------------------------ measuring


@query("large_boxes", BOXES_SQL, "select page_id, box_id, area from geo where area > 500")
def large_boxes(spark, d):
    return ms.variant(fx.plain_boxes(spark, d), "large").select("page_id", "box_id", "area")


@query("equal_sided_boxes", BOXES_SQL, "select page_id, box_id, area from geo where abs(w - h) < 5")
def equal_sided_boxes(spark, d):
    return ms.variant(fx.plain_boxes(spark, d), "equal_sides").select("page_id", "box_id", "area")


@query("config_sizes", BOXES_SQL, "select count(*) as n, min(w) as w_min, max(w) as w_max, round(avg(w), 6) as w_mean, min(h) as h_min, max(h) as h_max, round(avg(h), 6) as h_mean from boxes where w between 20 and 40 and h between 20 and 40")
def config_sizes(spark, d):
    return ms.config_sizes(fx.plain_boxes(spark, d), 20, 40)


@query("suggest_range_by_dpi", BOXES_SQL, """sq as (select case when page_id % 3 = 0 then 300 else 200 end as dpi, (w + h) / cast(2 as double) as side from geo where aspect_ratio > cast(0.85 as double) and aspect_ratio < cast(1.15 as double) and area > 50),
st as (select dpi, avg(side) as m, stddev_pop(side) as s from sq group by dpi)""", "select dpi, count(*) as n, min(side) as lo, max(side) as hi, greatest(1, cast(trunc(min(side) - 3) as bigint)) as suggested_min, cast(trunc(max(side) + 3) as bigint) as suggested_max from sq join st using (dpi) where abs(side - m) < 2 * s group by dpi")
def suggest_range_by_dpi(spark, d):
    return ms.suggest_range_by(fx.plain_boxes(spark, d).withColumn("dpi", F.when(F.col("page_id") % 3 == 0, 300).otherwise(200)), "dpi")


@query("clicked_size", BOXES_SQL, "select page_id, box_id, x, y, w, h from boxes")
def clicked_size(spark, d):
    """Boxes measured again from clicks on two opposite corners, in either order."""
    odd = F.col("box_id") % 2 == 1
    right, low = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    clicks = fx.plain_boxes(spark, d).select("page_id", "box_id", F.when(odd, right).otherwise(F.col("x")).alias("x0"), F.when(odd, F.col("x")).otherwise(right).alias("x1"), low.alias("y0"), F.col("y").alias("y1"))
    return ms.clicked_size(clicks).select("page_id", "box_id", "x", "y", "w", "h")
