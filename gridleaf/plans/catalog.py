"""All queries over the driver's tables and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fill as fills
from ..functions import geometry as g
from ..functions.text import ANSWER_NAMES, answer_columns, clean
from ..operators import boxes as bx
from ..operators import correlate as co
from ..operators import mapping as mp
from ..operators import measure as ms
from ..operators import quality as qu
from ..operators import text as tx
from ..sources import fixtures as fx
from ..sources.fixtures import BOXES_SQL, RASTERS_SQL, TEXTS_SQL, WORDS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
W, H = fx.PAGE_WIDTH, fx.PAGE_HEIGHT


def query(name: str, *sql: str):
    """Register a query; sql: common table expressions and, last, the select."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ctes = [s for s in sql[:-1] if s]
            ORACLES[name] = ("with recursive " + ",\n".join(ctes) + "\n" if ctes else "") + sql[-1]
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """To six digits as SQL's round: on the binary value times 10^6; Spark's round(c, 6) takes the shortest decimal form."""
    return df.withColumns({c: F.round(F.col(c) * 1e6) / 1e6 for c in cols})


# ------------------------------------------------------------------ boxes


@query("box_geometry", BOXES_SQL, "select page_id, box_id, cx, cy, area, round(aspect_ratio, 6) as aspect_ratio from geo")
def box_geometry(spark, d):
    return rounded(g.with_geometry(fx.plain_boxes(spark, d)).select("page_id", "box_id", "cx", "cy", "area", "aspect_ratio"), "aspect_ratio")


_EXCLUDED = "(cx between 0 and 1700 and cy between 0 and 220 or cx between 0 and 1700 and cy between 2090 and 2200)"


@query("exclusion_filter", BOXES_SQL, f"select page_id, box_id from geo where not {_EXCLUDED}")
def exclusion_filter(spark, d):
    return bx.split_excluded(fx.plain_boxes(spark, d), bx.exclusion_bounds(W, H))[0].select("page_id", "box_id")


@query("excluded_boxes", BOXES_SQL, f"select page_id, box_id from geo where {_EXCLUDED}")
def excluded_boxes(spark, d):
    return bx.split_excluded(fx.plain_boxes(spark, d), bx.exclusion_bounds(W, H))[1].select("page_id", "box_id")


@query("box_size_filter", BOXES_SQL, "select page_id, box_id, area from geo where area > 400 and area < 1600 and aspect_ratio > cast(0.8 as double) and aspect_ratio < cast(1.2 as double)")
def box_size_filter(spark, d):
    return bx.size_filter(fx.plain_boxes(spark, d)).select("page_id", "box_id", "area")


def _inter(a: str, b: str) -> str:
    return f"cast(greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) as double)"


def _overlap(a: str, b: str) -> str:
    return f"{_inter(a, b)} / least({a}.w * {a}.h, {b}.w * {b}.h)"


def _iou(a: str, b: str) -> str:
    return f"{_inter(a, b)} / ({a}.w * {a}.h + {b}.w * {b}.h - {_inter(a, b)})"


def _pair_sql(rule: str) -> str:
    return f"select a.page_id, a.box_id as box_a, b.box_id as box_b, round({rule}, 6) as ratio from boxes a join boxes b on a.page_id = b.page_id and a.box_id < b.box_id where {rule} > cast(0.5 as double)"


@query("overlap_pairs", BOXES_SQL, _pair_sql(_overlap("a", "b")))
def overlap_pairs(spark, d):
    return rounded(bx.overlap_pairs(fx.plain_boxes(spark, d), g.overlap_ratio("a_", "b_")), "ratio")


@query("iou_pairs", BOXES_SQL, _pair_sql(_iou("a", "b")))
def iou_pairs(spark, d):
    return rounded(bx.overlap_pairs(fx.plain_boxes(spark, d), g.iou("a_", "b_")), "ratio")


def nms_sql(source: str) -> str:
    """ranked and kept_boxes: greedy removal, one step a rank."""
    return f"""ranked as (select *, row_number() over (partition by page_id order by fill_score desc, box_id) as r from {source}),
fold(page_id, r, kept) as (select page_id, cast(0 as bigint), cast([] as struct(box_id bigint, x bigint, y bigint, w bigint, h bigint)[]) from (select distinct page_id from ranked)
 union all select f.page_id, f.r + 1, case when len(list_filter(f.kept, lambda k: {_overlap("k", "b")} > cast(0.5 as double))) > 0 then f.kept
  else list_append(f.kept, struct_pack(box_id := b.box_id, x := b.x, y := b.y, w := b.w, h := b.h)) end from fold f join ranked b on b.page_id = f.page_id and b.r = f.r + 1),
last_fold as (select page_id, arg_max(kept, r) as kept from fold group by page_id),
kept_boxes as (select page_id, unnest(range(1, len(kept) + 1)) as seq, unnest(list_transform(kept, lambda k: k.box_id)) as box_id from last_fold)"""


@query("nms_kept", BOXES_SQL, nms_sql("geo"), "select page_id, box_id, seq from kept_boxes")
def nms_kept(spark, d):
    return bx.remove_overlaps(fx.plain_boxes(spark, d)).where("kept").select("page_id", "box_id", F.col("seq").cast("long").alias("seq"))


@query("nms_removed", BOXES_SQL, nms_sql("geo"), "select page_id, box_id from boxes anti join kept_boxes using (page_id, box_id)")
def nms_removed(spark, d):
    return bx.remove_overlaps(fx.plain_boxes(spark, d)).where("not kept").select("page_id", "box_id")


@query("merge_detections", BOXES_SQL, f"""ones as (select page_id, list(struct_pack(box_id := box_id, x := x, y := y, w := w, h := h) order by box_id) as kept from boxes where box_id % 2 = 0 group by page_id),
twos as (select *, row_number() over (partition by page_id order by box_id) as r from boxes where box_id % 2 = 1),
fold(page_id, r, kept) as (select page_id, cast(0 as bigint), kept from ones
 union all select f.page_id, f.r + 1, case when len(list_filter(f.kept, lambda k: {_iou("k", "b")} > cast(0.5 as double))) > 0 then f.kept
  else list_append(f.kept, struct_pack(box_id := b.box_id, x := b.x, y := b.y, w := b.w, h := b.h)) end from fold f join twos b on b.page_id = f.page_id and b.r = f.r + 1),
last_fold as (select page_id, arg_max(kept, r) as kept from fold group by page_id)""",
"select page_id, unnest(list_transform(kept, lambda k: k.box_id)) as box_id from last_fold union all select page_id, box_id from twos where page_id not in (select page_id from ones)")
def merge_detections(spark, d):
    b = fx.plain_boxes(spark, d)
    return bx.merge_detections(b.where("box_id % 2 = 0"), b.where("box_id % 2 = 1")).select("page_id", "box_id")


@query("reading_order", BOXES_SQL, "select page_id, box_id, row_number() over (partition by page_id order by cy, cx, box_id) as by_center, row_number() over (partition by page_id order by y, x, box_id) as by_corner from geo")
def reading_order(spark, d):
    b = bx.reading_order(fx.plain_boxes(spark, d)).withColumnRenamed("position", "by_center")
    return bx.reading_order(b, by_center=False).select("page_id", "box_id", "by_center", F.col("position").alias("by_corner"))


def rows_sql(source: str, seq: str) -> str:
    """placed: row_num and position by an anchored row fold."""
    return f"""by_y as (select *, row_number() over (partition by page_id order by y, {seq}) as n from {source}),
rowfold(page_id, n, anchor, row_num, box_id) as (select page_id, n, y, 1, box_id from by_y where n = 1
 union all select b.page_id, b.n, case when abs(b.y - f.anchor) > 15 then b.y else f.anchor end, case when abs(b.y - f.anchor) > 15 then f.row_num + 1 else f.row_num end, b.box_id
  from rowfold f join by_y b on b.page_id = f.page_id and b.n = f.n + 1),
placed as (select b.*, f.row_num, row_number() over (partition by b.page_id order by f.row_num, b.x, b.n) as position from rowfold f join by_y b on b.page_id = f.page_id and b.box_id = f.box_id)"""


@query("row_order", BOXES_SQL, rows_sql("boxes", "box_id"), "select page_id, box_id, cast(row_num as bigint) as row_num, position from placed")
def row_order(spark, d):
    return bx.row_order(fx.plain_boxes(spark, d)).select("page_id", "box_id", "row_num", "position")


@query("row_report", BOXES_SQL, rows_sql("boxes", "box_id"), "select page_id, cast(row_num as bigint) as row_num, count(*) as n_boxes, cast(sum(y) as bigint) // count(*) as mean_y from placed group by page_id, row_num")
def row_report(spark, d):
    return bx.row_report(bx.row_order(fx.plain_boxes(spark, d)))


_FLAGSHIP = (BOXES_SQL, f"inside as (select * from geo where not {_EXCLUDED})", nms_sql("inside"), "final_boxes as (select i.*, k.seq from inside i join kept_boxes k on i.page_id = k.page_id and i.box_id = k.box_id)", rows_sql("final_boxes", "seq"))
_AT = {n: i + 1 for i, n in enumerate(ANSWER_NAMES)}


@query("wide_answers", *_FLAGSHIP, "select page_id, " + ", ".join(f'bool_or(is_filled) filter (where position = {_AT[n]}) as "{n}"' for n in answer_columns()) + " from placed group by page_id")
def wide_answers(spark, d):
    return bx.answers(fx.plain_boxes(spark, d), W, H)


@query("wide_boxes", BOXES_SQL, rows_sql("boxes", "box_id"), "select page_id, " + ", ".join(f"bool_or(is_filled) filter (where position = {i}) as box{i}" for i in range(1, 51)) + " from placed group by page_id")
def wide_boxes(spark, d):
    """At least the SQL's 50 columns, and one for each further position in the data (sf0.1 has 53)."""
    return bx.wide_boxes(bx.row_order(fx.plain_boxes(spark, d)), 50)


@query("fill_summary", BOXES_SQL, "select page_id, count(*) as total, count_if(is_filled) as filled, count(*) - count_if(is_filled) as empty, round(count_if(is_filled) / count(*), 6) as fill_rate from boxes group by page_id")
def fill_summary(spark, d):
    return bx.fill_summary(fx.plain_boxes(spark, d))


# ------------------------------------------------------------------ fill


def _vote_sql(at: int) -> str:
    return " + ".join(f"case when {r[0]} > cast({r[1]} as double) then cast({r[at]} as double) else cast(0 as double) end" for r in fills.RULES)


_VOTE = f"vote as (select *, cast(0 as double) + {_vote_sql(2)} as filled_score, least(cast(0 as double) + {_vote_sql(3)}, 1) as confidence from boxes)"


@query("fill_rules", BOXES_SQL, _VOTE, "select page_id, box_id, round(filled_score, 6) as filled_score, round(confidence, 6) as confidence, filled_score > cast(0.4 as double) as is_filled from vote")
def fill_rules(spark, d):
    return rounded(fills.rule_vote(fx.boxes(spark, d)).select("page_id", "box_id", "filled_score", "confidence", "is_filled"), "filled_score", "confidence")


_PX = """px_stats as (select page_id, cast(len(list_filter(px, lambda v: v < 200)) as double) / 16 as dark, cast(list_sum(px) as double) / 16 as mean_,
 cast(16 * list_sum(list_transform(px, lambda v: v * v)) - list_sum(px) * list_sum(px) as double) / 256 as var_ from inner_px)"""
_NEW = "(0.5 * least(1.0, dark * 5.0) + 0.3 * least(1.0, var_ / 1000.0) + 0.2 * greatest(0.0, 1.0 - mean_ / 255.0))"
_OLD = "(0.7 * dark + 0.3 * least(1.0, var_ / 1000.0))"


@query("raster_fill", RASTERS_SQL, _PX, f"select page_id, round({_NEW} + 1e-9, 6) as fill_score, {_NEW} > 0.15 as is_filled, round({_OLD} + 1e-9, 6) as older_score, {_OLD} > 0.15 as older_filled from px_stats")
def raster_fill(spark, d):
    px = fx.rasters(spark, d).select("page_id", fills.interior(F.col("pixels"), 8, 8).alias("px"))
    s, old = fills.pixel_fill(F.col("px")), fills.pixel_fill_older(F.col("px"))
    # 1e-9 keeps exact halves of the last digit from rounding differently in the two engines
    return px.select("page_id", F.round(s + 1e-9, 6).alias("fill_score"), (s > fills.FILL_THRESHOLD).alias("is_filled"), F.round(old + 1e-9, 6).alias("older_score"), (old > fills.FILL_THRESHOLD).alias("older_filled"))


@query("raster_density", RASTERS_SQL, """select page_id, round(cast(len(list_filter(pixels, lambda v: v < 127)) as double) / 64, 6) as dark_ratio, round(cast(1 as double) - cast(len(list_filter(pixels, lambda v: v < 127)) as double) / 64, 6) as light_ratio,
round(cast(list_sum(pixels) as double) / 64, 6) as mean_intensity, round(sqrt(cast(64 * list_sum(list_transform(pixels, lambda v: v * v)) - list_sum(pixels) * list_sum(pixels) as double) / 4096), 6) as std_intensity from rasters""")  # fmt: skip
def raster_density(spark, d):
    p = F.col("pixels")
    dark = fills.share_below(p, 127)
    return fx.rasters(spark, d).select("page_id", F.round(dark, 6).alias("dark_ratio"), F.round(1.0 - dark, 6).alias("light_ratio"), F.round(fills.mean(p), 6).alias("mean_intensity"), F.round(F.sqrt(fills.variance(p)), 6).alias("std_intensity"))


# ------------------------------------------------------------------ text


def _lines(spark, d) -> DataFrame:
    return tx.assemble_lines(fx.words(spark, d))


@query("word_filter", WORDS_SQL, "select page_id, line_num, word_num, text, confidence from words where confidence > 0 and trim(text) <> ''")
def word_filter(spark, d):
    return tx.valid_words(fx.words(spark, d)).select("page_id", "line_num", "word_num", "text", "confidence")


@query("line_assembly", WORDS_SQL, "select page_id, line_num, text, x, y, w, cast(h as bigint) as h, (x + x + w) // 2 as cx, cast((y + y + h) // 2 as bigint) as cy, round(confidence, 6) as confidence, word_count from lines")
def line_assembly(spark, d):
    return rounded(_lines(spark, d), "confidence")


_CATEGORY = """case when contains(text, '?') or regexp_matches(lower(text), '^(what|how|when|where|why|which)') then 'question' when length(text) < 50 and confidence > 60 then 'option' else 'other' end"""


@query("text_category", WORDS_SQL, f"select page_id, line_num, {_CATEGORY} as category from lines")
def text_category(spark, d):
    return tx.categorise(_lines(spark, d)).select("page_id", "line_num", "category")


@query("category_counts", WORDS_SQL, f"""cats as (select *, {_CATEGORY} as category from lines)""", """select page_id, count(*) as total_regions, count_if(category = 'question') as question_count,
count_if(category = 'option') as option_count, count_if(category = 'other') as other_count, round(avg(confidence), 6) as avg_confidence from cats group by page_id""")  # fmt: skip
def category_counts(spark, d):
    return tx.category_counts(_lines(spark, d))


_CLEAN = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s.,?!\-()\[\]]', '', 'g')"


@query("clean_text", WORDS_SQL, f"select page_id, line_num, {_CLEAN} as cleaned_text from lines")
def clean_text(spark, d):
    return _lines(spark, d).select("page_id", "line_num", clean(F.col("text")).alias("cleaned_text"))


@query("label_filter", WORDS_SQL, f"select page_id, line_num, {_CLEAN} as cleaned_text from lines where confidence >= 50 and length({_CLEAN}) >= 2")
def label_filter(spark, d):
    return tx.label_filter(_lines(spark, d)).select("page_id", "line_num", "cleaned_text")


@query("label_pool", WORDS_SQL, f"cats as (select *, {_CATEGORY} as category from lines)", "select page_id, line_num, category from cats where category <> 'question' or page_id not in (select page_id from cats where category <> 'question')")
def label_pool(spark, d):
    return tx.label_pool(_lines(spark, d)).select("page_id", "line_num", "category")


# ------------------------------------------------------------------ correlation

_DIR = "case when abs(dx) > abs(dy) then case when dx > 0 then 'right' else 'left' end else case when dy > 0 then 'below' else 'above' end end"
_PAIRS = f"""pairs as (select *, sqrt(cast(dx * dx + dy * dy as double)) as dist, {_DIR} as direction from (select b.page_id, b.box_id, b.cx, b.cy, t.text_id, t.cx - b.cx as dx, t.cy - b.cy as dy from geo b join texts t on b.page_id = t.page_id)),
near1 as (select * from (select *, row_number() over (partition by page_id, box_id order by dist, text_id) as r from pairs where dist <= 150) where r = 1)"""
_LAYOUT = """dirs as (select page_id, count(*) as n, count_if(direction = 'right') as "right", count_if(direction = 'left') as "left", count_if(direction = 'below') as below, count_if(direction = 'above') as above from near1 group by page_id),
layout as (select p.page_id, p.n_boxes, case when p.page_id not in (select page_id from texts) then 'unknown' when "right" / n > cast(0.7 as double) then 'right_labels' when "left" / n > cast(0.7 as double) then 'left_labels'
 when below / n > cast(0.5 as double) then 'below_labels' when above / n > cast(0.5 as double) then 'above_labels' else 'mixed' end as layout_type,
 case when n is null then null when above = greatest("right", "left", below, above) then 'above' when below = greatest("right", "left", below, above) then 'below' when "left" = greatest("right", "left", below, above) then 'left' else 'right' end as dominant_direction
 from (select page_id, count(*) as n_boxes from boxes group by page_id) p left join dirs d on p.page_id = d.page_id)"""
_BT = (BOXES_SQL, TEXTS_SQL, _PAIRS)


def _bt(spark, d) -> tuple[DataFrame, DataFrame]:
    return fx.plain_boxes(spark, d), fx.texts(spark, d)


@query("nearest_text", *_BT, "select page_id, box_id, text_id, round(dist, 6) as dist, direction, row_number() over (partition by page_id, box_id order by dist, text_id) as rank from pairs where dist <= 200")
def nearest_text(spark, d):
    return rounded(co.nearest_texts(*_bt(spark, d)), "dist")


@query("nearest_one", *_BT, "select page_id, box_id, text_id, round(dist, 6) as dist, direction from near1")
def nearest_one(spark, d):
    return rounded(co.nearest_one(*_bt(spark, d)), "dist")


@query("layout_type", *_BT, _LAYOUT, "select page_id, layout_type, n_boxes from layout")
def layout_type(spark, d):
    return co.layouts(*_bt(spark, d)).select("page_id", "layout_type", "n_boxes")


@query("dominant_direction", *_BT, _LAYOUT, "select page_id, dominant_direction from layout")
def dominant_direction(spark, d):
    return co.layouts(*_bt(spark, d)).select("page_id", "dominant_direction")


@query("box_clusters", BOXES_SQL, """close as (select a.page_id, a.box_id as a, b.box_id as b from geo a join geo b on a.page_id = b.page_id and a.box_id <> b.box_id and (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 10000),
reach(page_id, node, root) as (select page_id, a, least(a, b) from close union select r.page_id, c.b, r.root from reach r join close c on r.page_id = c.page_id and r.node = c.a),
roots as (select page_id, node, min(root) as root from reach group by page_id, node),
ranked as (select *, dense_rank() over (partition by page_id order by root) - 1 as cluster from roots)""",
"select b.page_id, b.box_id, case when count(*) over (partition by b.page_id) = 1 then 0 else coalesce(cluster, -1) end as cluster from boxes b left join ranked r on b.page_id = r.page_id and b.box_id = r.node")
def box_clusters(spark, d):
    return co.clusters(fx.plain_boxes(spark, d))


_ALIGN = """aligned as (select *, abs(dy) < 30 as flat, cast(case when abs(dy) < 30 then abs(dx) else abs(dy) end as double) as d,
 case when abs(dy) < 30 then case when dx > 0 then 'right' else 'left' end else case when dy > 0 then 'below' else 'above' end end as dir from pairs where abs(dy) < 30 or abs(dx) < 30),
best_aligned as (select * from (select *, row_number() over (partition by page_id, box_id order by flat desc, d, text_id) as r from aligned) where r = 1),
align_m as (select b.page_id, b.box_id, b.cy, b.cx, a.text_id, case when a.text_id is null then 0 else case when flat then cast(0.9 as double) else cast(0.7 as double) end * greatest(0, 1 - d / 100) * case when dir in ('right', 'below') then cast(0.9 as double) else cast(0.8 as double) end end as confidence,
 coalesce(d, cast('Infinity' as double)) as distance, coalesce(dir, 'unknown') as direction, case when a.text_id is null then 'none' when flat then 'horizontal' else 'vertical' end as alignment
 from geo b left join best_aligned a on a.page_id = b.page_id and a.box_id = b.box_id)"""
_PROX = """cands as (select page_id, box_id, cy, cx, list(struct_pack(dist := dist, text_id := text_id, direction := direction) order by dist, text_id) as c from pairs where dist <= 150 group by all),
turn as (select *, row_number() over (partition by page_id order by cy, cx, box_id) as n from cands),
greedy(page_id, n, used, box_id, m) as (select page_id, cast(0 as bigint), cast([] as bigint[]), cast(null as bigint), cast(null as struct(dist double, text_id bigint, direction varchar)) from (select distinct page_id from turn)
 union all select g.page_id, t.n, list_concat(g.used, list_transform(list_filter(t.c, lambda k: not list_contains(g.used, k.text_id))[1:1], lambda k: k.text_id)), t.box_id, list_filter(t.c, lambda k: not list_contains(g.used, k.text_id))[1]
  from greedy g join turn t on t.page_id = g.page_id and t.n = g.n + 1),
prox_m as (select b.page_id, b.box_id, b.cy, b.cx, m.text_id as text_id, case when m is null then 0 else greatest(0, 1 - m.dist / 200) * case when m.direction in ('right', 'below') then cast(0.9 as double) else cast(0.7 as double) end end as confidence,
 coalesce(m.dist, cast('Infinity' as double)) as distance, coalesce(m.direction, 'unknown') as direction, 'none' as alignment from geo b left join greedy g on g.page_id = b.page_id and g.box_id = b.box_id)"""
_M = "page_id, box_id, text_id, round(confidence, 6) as confidence, round(distance, 6) as distance, direction, alignment"
_ADAPT = """chosen as (select a.* from align_m a join layout l on a.page_id = l.page_id where l.layout_type like '%labels' union all select p.* from prox_m p join layout l on p.page_id = l.page_id where l.layout_type not like '%labels'),
adapt_ranked as (select *, row_number() over (partition by page_id, text_id order by confidence desc, cy, cx, box_id) as rk from chosen),
adapt as (select page_id, box_id, case when rk = 1 then text_id end as text_id, case when text_id is not null and rk > 1 then 0 else confidence end as confidence, distance, direction, alignment from adapt_ranked)"""
_ADAPT = _ADAPT.replace("case when rk = 1 then text_id end as text_id", "case when text_id is not null and rk = 1 then text_id end as text_id")


def _match(df: DataFrame) -> DataFrame:
    return rounded(df.select(*co._MATCH), "confidence", "distance")


@query("align_match", *_BT, _ALIGN, f"select {_M} from align_m")
def align_match(spark, d):
    return _match(co.align_match(*_bt(spark, d)))


@query("proximity_match", *_BT, _PROX, f"select {_M} from prox_m")
def proximity_match(spark, d):
    return _match(co.proximity_match(*_bt(spark, d)))


_ALL = (*_BT, _LAYOUT, _ALIGN, _PROX, _ADAPT)


@query("adaptive_match", *_ALL, f"select {_M} from adapt")
def adaptive_match(spark, d):
    return _match(co.adaptive_match(*_bt(spark, d)))


_ITEMS = """items as (select a.page_id, row_number() over (partition by a.page_id order by a.box_id) - 1 as item_id, a.box_id, b.is_filled, coalesce(t.text, 'Checkbox ' || a.box_id) as label,
 coalesce(cast(t.confidence as double), 0) as label_confidence, a.confidence as correlation_confidence, a.distance, a.direction from adapt a join boxes b on a.page_id = b.page_id and a.box_id = b.box_id left join texts t on a.page_id = t.page_id and a.text_id = t.text_id)"""
_META = """meta as (select page_id, count(*) as total_checkboxes, count_if(label_confidence > 0) as matched_labels, count_if(label_confidence > 0) / count(*) as match_rate, avg(correlation_confidence) as avg_correlation_confidence, count_if(is_filled) as filled from items group by page_id)"""


def _items(spark, d) -> DataFrame:
    b, t = _bt(spark, d)
    return co.survey_items(b, t, co.adaptive_match(b, t))


@query("survey_items", *_ALL, _ITEMS, "select page_id, item_id, box_id, is_filled, label, label_confidence, round(correlation_confidence, 6) as correlation_confidence, round(distance, 6) as distance, direction from items")
def survey_items(spark, d):
    return rounded(_items(spark, d).drop("x", "y", "w", "h"), "correlation_confidence", "distance")


@query("survey_metadata", *_ALL, _ITEMS, _META, "select page_id, total_checkboxes, matched_labels, round(match_rate, 6) as match_rate, round(avg_correlation_confidence, 6) as avg_correlation_confidence, filled from meta")
def survey_metadata(spark, d):
    return rounded(co.survey_metadata(_items(spark, d)), "match_rate", "avg_correlation_confidence")


@query("batch_summary", *_ALL, _ITEMS, _META, "failed as (select count(*) as failed from part where p_partkey not in (select l_partkey from lineitem))", """select successful + failed as total_files_processed, successful, failed, cast(tc as bigint) as total_checkboxes_found, cast(tf as bigint) as total_checkboxes_filled,
round(tf / tc, 6) as overall_fill_rate, round(mr, 6) as average_match_rate from (select count(*) as successful, sum(total_checkboxes) as tc, sum(filled) as tf, avg(match_rate) as mr from meta), failed""")  # fmt: skip
def batch_summary(spark, d):
    """Pages without a detected box stand for the failed ones."""
    pages = fx.read(spark, d, "part").select(F.col("p_partkey").alias("page_id"))
    seen = fx.read(spark, d, "lineitem").select(F.col("l_partkey").alias("page_id"))
    errors = pages.join(seen, "page_id", "left_anti").withColumn("error", F.lit("no box"))
    return co.batch_summary(co.survey_metadata(_items(spark, d)), errors)


# ------------------------------------------------------------------ quality

_FLAGS = "flags as (select *, area < 100 as too_small, area > 2000 as too_large, not (aspect_ratio between cast(0.5 as double) and 2) as odd_shape, x < 0 or y < 0 or x + w > {w} or y + h > {h} as out_of_bounds from geo)"
_QDET = """qdet as (select *, score >= cast(0.6 as double) as valid from (select *, greatest(0, least(1, n_valid / n - least(cast(0.5 as double), n_issues * cast(0.1 as double)) + least(cast(0.2 as double), n / 20))) as score from (select page_id, count(*) as n,
 count_if(not too_small and not too_large) as n_valid, cast(sum(cast(too_small as int) + cast(too_large as int) + cast(odd_shape as int) + cast(out_of_bounds as int)) as bigint) as n_issues, avg(area) as avg_area, stddev_pop(area) as std_area,
 avg(aspect_ratio) as avg_aspect, stddev_pop(aspect_ratio) as std_aspect from flags group by page_id)))"""
_FL = _FLAGS.format(w=W, h=H)


def _detection(spark, d, w: int = W, h: int = H) -> DataFrame:
    return qu.detection(fx.plain_boxes(spark, d), w, h)


@query("quality_detection", BOXES_SQL, _FL, _QDET, "select page_id, n, n_valid, n_issues, round(avg_area, 4) as avg_area, round(std_area, 4) as std_area, round(avg_aspect, 6) as avg_aspect, round(std_aspect, 6) as std_aspect, round(score, 6) as score, valid from qdet")
def quality_detection(spark, d):
    out = _detection(spark, d).withColumns({"avg_area": F.round("avg_area", 4), "std_area": F.round("std_area", 4)})
    return rounded(out, "avg_aspect", "std_aspect", "score")


_QFILL = """qfill as (select *, score >= cast(0.5 as double) as valid from (select *, avg_confidence * (n_high / n) as score from (select page_id, count(*) as n, count_if(confidence >= cast(0.4 as double)) as n_high, avg(confidence) as avg_confidence,
 min(confidence) as min_confidence, max(confidence) as max_confidence, avg(filled_score) as avg_score, count_if(filled_score > cast(0.4 as double)) as n_filled from vote group by page_id)))"""


@query("quality_fill", BOXES_SQL, _VOTE, _QFILL, "select page_id, n, n_high, round(avg_confidence, 6) as avg_confidence, round(min_confidence, 6) as min_confidence, round(max_confidence, 6) as max_confidence, round(avg_score, 6) as avg_score, n_filled, round(score, 6) as score, valid from qfill")
def quality_fill(spark, d):
    """Means add up in file order, as SQL's do on one thread."""
    boxes = fx.boxes(spark, d, "struct(_metadata.file_path, _metadata.row_index) as place")
    return rounded(qu.fill(fills.rule_vote(boxes), order="place"), "avg_confidence", "min_confidence", "max_confidence", "avg_score", "score")


def _qtext(name: str, source: str) -> str:
    return f"""{name} as (select *, score >= cast(0.4 as double) as valid from (select *, (avg_confidence / 100 + least(1, n / 10)) / 2 as score from (select page_id, count(*) as n, count_if(confidence >= 30) as n_high, avg(confidence) as avg_confidence,
 cast(min(confidence) as double) as min_confidence, cast(max(confidence) as double) as max_confidence, avg(length(text)) as avg_length from {source} group by page_id)))"""


@query("quality_text", WORDS_SQL, _qtext("qtext", "lines"), "select page_id, n, n_high, round(avg_confidence, 6) as avg_confidence, round(min_confidence, 6) as min_confidence, round(max_confidence, 6) as max_confidence, round(avg_length, 4) as avg_length, round(score, 6) as score, valid from qtext")
def quality_text(spark, d):
    out = qu.text(_lines(spark, d)).withColumn("avg_length", F.round("avg_length", 4))
    return rounded(out, "avg_confidence", "min_confidence", "max_confidence", "score")


_QCOR = """qcor as (select *, score >= cast(0.5 as double) as valid from (select *, (match_rate + avg_confidence) / 2 as score from (select page_id, count(*) as n, count(text_id) as n_matched, count_if(text_id is not null and confidence >= cast(0.3 as double)) as n_high,
 avg(confidence) as avg_confidence, avg(distance) filter (where text_id is not null) as avg_distance, max(distance) filter (where text_id is not null) as max_distance, count_if(text_id is not null and distance > 200) as n_far, count(text_id) / count(*) as match_rate from adapt group by page_id)))"""


@query("quality_correlation", *_ALL, _QCOR, "select page_id, n, n_matched, n_high, round(avg_confidence, 6) as avg_confidence, round(avg_distance, 6) as avg_distance, round(max_distance, 6) as max_distance, n_far, round(match_rate, 6) as match_rate, round(score, 6) as score, valid from qcor")
def quality_correlation(spark, d):
    return rounded(qu.correlations(co.adaptive_match(*_bt(spark, d))), "avg_confidence", "avg_distance", "max_distance", "match_rate", "score")


_QIMG = """istats as (select page_id, 8 as width, 8 as height, cast(list_sum(pixels) as double) / 64 as brightness, sqrt(cast(64 * list_sum(list_transform(pixels, lambda v: v * v)) - list_sum(pixels) * list_sum(pixels) as double) / 4096) as contrast, cast(0 as double) as blur_score from rasters),
qimg as (select *, score >= cast(0.6 as double) as valid from (select *, (least(1, width / 1000) + least(1, contrast / 50) + case when brightness between 50 and 200 then 1 else greatest(0, 1 - abs(brightness - 125) / 125) end + least(1, blur_score / 200)) / 4 as score from istats))"""


def _image_stats(spark, d) -> DataFrame:
    p = F.col("pixels")
    return fx.rasters(spark, d).select("page_id", F.lit(8).alias("width"), F.lit(8).alias("height"), fills.mean(p).alias("brightness"), F.sqrt(fills.variance(p)).alias("contrast"), F.lit(0.0).alias("blur_score"))


@query("quality_image", RASTERS_SQL, _QIMG, "select page_id, round(contrast, 6) as contrast, round(brightness, 6) as brightness, round(score, 6) as score, valid from qimg")
def quality_image(spark, d):
    return rounded(qu.image(_image_stats(spark, d)).select("page_id", "contrast", "brightness", "score", "valid"), "contrast", "brightness", "score")


_QALL = (*_ALL, RASTERS_SQL, _FL, _QDET, _VOTE, _QFILL, _qtext("qtext", "texts"), _QCOR, _QIMG, """overall as (select page_id, i.score as image_score, d.score as checkbox_detection_score, f.score as fill_analysis_score, t.score as text_extraction_score, c.score as correlations_score,
 (i.score + d.score + f.score + t.score + c.score) / 5 as score, i.valid and d.valid and f.valid and t.valid and c.valid as valid from qimg i join qdet d using (page_id) join qfill f using (page_id) join qtext t using (page_id) join qcor c using (page_id)),
graded as (select *, case when score >= cast(0.9 as double) then 'A' when score >= cast(0.8 as double) then 'B' when score >= cast(0.7 as double) then 'C' when score >= cast(0.6 as double) then 'D' else 'F' end as grade,
 [image_score, checkbox_detection_score, fill_analysis_score, text_extraction_score, correlations_score] as s from overall)""")  # fmt: skip
_NAMES = "['image', 'checkbox_detection', 'fill_analysis', 'text_extraction', 'correlations']"


def _overall(spark, d, every_page: bool = False) -> DataFrame:
    b, t = _bt(spark, d)
    return qu.overall({"image": qu.image(_image_stats(spark, d)), "checkbox_detection": _detection(spark, d), "fill_analysis": qu.fill(fills.rule_vote(fx.boxes(spark, d))), "text_extraction": qu.text(t), "correlations": qu.correlations(co.adaptive_match(b, t))}, every_page)


@query("quality_overall", *_QALL, f"select page_id, round(score, 6) as score, valid, grade, {_NAMES}[list_position(s, list_max(s))] as best, {_NAMES}[list_position(s, list_min(s))] as worst from graded")
def quality_overall(spark, d):
    return rounded(_overall(spark, d).select("page_id", "score", "valid", "grade", "best", "worst"), "score")


@query("quality_issues", BOXES_SQL, _FLAGS.format(w=1400, h=2000), """select page_id, '[checkbox_detection] Checkbox ' || box_id || ' too small: ' || area || ' pixels' as issue from flags where too_small
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' too large: ' || area || ' pixels' from flags where too_large
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' extends outside image bounds' from flags where out_of_bounds""")  # fmt: skip
def quality_issues(spark, d):
    """Issues of boxes on images of 1400 x 2000; no box has an odd shape here, whose text has a rounded ratio."""
    return qu.issue_texts(qu.detection_issues(fx.plain_boxes(spark, d), 1400, 2000)).select("page_id", "issue")


_ADVICE_SQL = " union all ".join(f"select page_id, {i} as ord, '{said}' as recommendation from graded join istats using (page_id) where {c}_score < cast({limit} as double) and {rule}" for i, (c, limit, rule, said) in enumerate(qu.ADVICE))


@query("recommendations", *_QALL, _ADVICE_SQL)
def recommendations(spark, d):
    return qu.recommendations(_overall(spark, d), _image_stats(spark, d))


# the same over every page that any component has, and with the issues of all five components

_QEVERY = (*_QALL[:-1], """overall as (select page_id, coalesce(i.score, 0) as image_score, coalesce(d.score, 0) as checkbox_detection_score, coalesce(f.score, 0) as fill_analysis_score, coalesce(t.score, 0) as text_extraction_score, coalesce(c.score, 0) as correlations_score,
 (coalesce(i.score, 0) + coalesce(d.score, 0) + coalesce(f.score, 0) + coalesce(t.score, 0) + coalesce(c.score, 0)) / 5 as score, coalesce(i.valid and d.valid and f.valid and t.valid and c.valid, false) as valid
 from qimg i full join qdet d using (page_id) full join qfill f using (page_id) full join qtext t using (page_id) full join qcor c using (page_id))""", _QALL[-1][_QALL[-1].index("graded as"):])  # fmt: skip


@query("quality_overall_every_page", *_QEVERY, f"select page_id, round(score, 6) as score, valid, grade, {_NAMES}[list_position(s, list_max(s))] as best, {_NAMES}[list_position(s, list_min(s))] as worst from graded")
def quality_overall_every_page(spark, d):
    return rounded(_overall(spark, d, True).select("page_id", "score", "valid", "grade", "best", "worst"), "score")


@query("recommendations_every_page", *_QEVERY, _ADVICE_SQL.replace("graded join istats", "graded left join istats"))
def recommendations_every_page(spark, d):
    return qu.recommendations(_overall(spark, d, True), _image_stats(spark, d))


@query("quality_issues_all_components", *_QALL[:-1], "all_pages as (select page_id from rasters union select page_id from boxes union select page_id from texts)", """select page_id, '[image] Low resolution: ' || width || 'x' || height || ' (recommend >1000x1000)' as issue from istats where width < 1000 or height < 1000
union all select page_id, '[image] Low contrast: ' || printf('%.1f', contrast) || ' (recommend >20)' from istats where contrast < 20
union all select page_id, '[image] Poor brightness: ' || printf('%.1f', brightness) || ' (recommend 50-200)' from istats where not (brightness between 50 and 200)
union all select page_id, '[image] Image appears blurry: ' || printf('%.1f', blur_score) || ' (recommend >100)' from istats where blur_score < 100
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' too small: ' || area || ' pixels' from flags where too_small
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' too large: ' || area || ' pixels' from flags where too_large
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' has unusual aspect ratio: ' || printf('%.2f', aspect_ratio) from flags where odd_shape
union all select page_id, '[checkbox_detection] Checkbox ' || box_id || ' extends outside image bounds' from flags where out_of_bounds
union all select page_id, '[fill_analysis] Checkbox ' || box_id || ' has low fill confidence: ' || printf('%.3f', confidence) from vote where confidence < cast(0.4 as double)
union all select page_id, '[text_extraction] Low confidence text: ' || chr(39) || text || chr(39) || ' (' || confidence || ')' from texts where confidence < 30
union all select page_id, '[correlations] Low confidence correlation for checkbox ' || box_id || ': ' || printf('%.3f', confidence) from adapt where text_id is not null and confidence < cast(0.3 as double)
union all select page_id, '[correlations] Large correlation distance for checkbox ' || box_id || ': ' || printf('%.1f', distance) || 'px' from adapt where text_id is not null and distance > 200
union all select page_id, '[correlations] No text match found for checkbox ' || box_id from adapt where text_id is null
union all select page_id, unnest(['[checkbox_detection] No checkboxes detected', '[fill_analysis] No analyzed checkboxes provided', '[correlations] No correlations provided']) from all_pages where page_id not in (select page_id from boxes)
union all select page_id, '[text_extraction] No text extracted' from all_pages where page_id not in (select page_id from texts)""")  # fmt: skip
def quality_issues_all_components(spark, d):
    b, t = _bt(spark, d)
    return qu.all_issues(_image_stats(spark, d), qu.detection_issues(fx.plain_boxes(spark, d), W, H), fills.rule_vote(fx.boxes(spark, d)), t, co.adaptive_match(b, t))


# ------------------------------------------------------------------ measures

_STATS = ", ".join(f"min({c}) as {n}_min, max({c}) as {n}_max, round(avg({c}), 6) as {n}_mean, round(stddev_pop({c}), 6) as {n}_std" for c, n in (("w", "width"), ("h", "height"), ("area", "area")))


@query("box_stats", BOXES_SQL, f"select count(*) as n, {_STATS} from geo")
def box_stats(spark, d):
    return ms.box_stats(fx.plain_boxes(spark, d))


@query("common_sizes", BOXES_SQL, "tw as (select w as size, count(*) as n from boxes group by w order by n desc, size limit 5), th as (select h as size, count(*) as n from boxes group by h order by n desc, size limit 5)",
       "select 'w' as side, row_number() over (order by n desc, size) as rank, size, n from tw where n > 2 union all select 'h', row_number() over (order by n desc, size), size, n from th where n > 2")
def common_sizes(spark, d):
    b = fx.plain_boxes(spark, d)
    return ms.common_sizes(b, "w").select(F.lit("w").alias("side"), "*").unionByName(ms.common_sizes(b, "h").select(F.lit("h").alias("side"), "*"))


_SIZED = "sized as (select *, aspect_ratio > cast(0.9 as double) and aspect_ratio < cast(1.1 as double) as is_square from geo where area > 100 and area < 5000)"


@query("size_buckets", BOXES_SQL, _SIZED, "top as (select (w // 10 * 10) || 'x' || (h // 10 * 10) as bucket, count(*) as n from sized where not is_square group by 1 order by n desc, bucket limit 5)", "select row_number() over (order by n desc, bucket) as rank, bucket, n from top where n > 1")
def size_buckets(spark, d):
    return ms.size_buckets(fx.plain_boxes(spark, d))


@query("square_sizes", BOXES_SQL, _SIZED, "top as (select (w + h) // 2 as size, count(*) as n from sized where is_square group by 1 order by n desc, size limit 5)", "select row_number() over (order by n desc, size) as rank, size, n from top")
def square_sizes(spark, d):
    return ms.square_sizes(fx.plain_boxes(spark, d))


@query("square_stats", BOXES_SQL, _SIZED, "select count(*) as n, round(avg((w + h) / 2), 6) as mean, round(stddev_pop((w + h) / 2), 6) as std, min((w + h) / 2) as least, max((w + h) / 2) as most from sized where is_square")
def square_stats(spark, d):
    return ms.square_stats(fx.plain_boxes(spark, d))


@query("suggest_range", BOXES_SQL, "sq as (select (w + h) / 2 as side from geo where aspect_ratio > cast(0.85 as double) and aspect_ratio < cast(1.15 as double) and area > 50), st as (select avg(side) as m, stddev_pop(side) as s from sq)",
       "select count(*) as n, min(side) as lo, max(side) as hi, round(avg(side), 6) as mean, cast(greatest(1, trunc(min(side) - 3)) as bigint) as suggested_min, cast(trunc(max(side) + 3) as bigint) as suggested_max from sq, st where abs(side - m) < 2 * s")
def suggest_range(spark, d):
    return ms.suggest_range(fx.plain_boxes(spark, d))


@query("grid_sweep", BOXES_SQL, """grid as (select lo * 3 + hi as k, [100, 400, 900][lo + 1] as min_area, [1000, 1600, 2500][hi + 1] as max_area from range(3) a(lo), range(3) b(hi)),
sweep as (select k, min_area, max_area, count(*) as n, avg(w) as avg_size from geo, grid where aspect_ratio > cast(0.8 as double) and aspect_ratio < cast(1.2 as double) and area > min_area and area < max_area group by all)""",
"select cast(min_area as bigint) as min_area, cast(max_area as bigint) as max_area, n, round(avg_size, 6) as avg_size, k = (select k from sweep order by n desc, k limit 1) as best from sweep")
def grid_sweep(spark, d):
    return ms.grid_sweep(fx.plain_boxes(spark, d), [100, 400, 900], [1000, 1600, 2500])


@query("largest_boxes", BOXES_SQL, "select page_id, box_id, area from geo order by area desc, page_id, box_id limit 10")
def largest_boxes(spark, d):
    return ms.largest(fx.plain_boxes(spark, d))


# ------------------------------------------------------------------ mapping

_SAVED = "saved as (select position as ord, 'q' || position as column_name, x + 10 as x, y + 10 as y, w as width, h as height, box_id as original_id, fill_score from placed where page_id = (select min(page_id) from boxes))"


def _saved(spark, d) -> tuple[DataFrame, DataFrame]:
    """All ordered boxes, and the first page's as a saved mapping that is 10 pixels off."""
    ordered = bx.row_order(fx.plain_boxes(spark, d))
    first = fx.read(spark, d, "lineitem").agg(F.min("l_partkey").alias("first"))
    page = fx.plain_boxes(spark, d).join(F.broadcast(first), F.col("page_id") == F.col("first"))
    return ordered, mp.saved_mapping(bx.row_order(page.drop("first")), shift=10)


@query("saved_mapping_match", BOXES_SQL, rows_sql("boxes", "box_id"), _SAVED, """select p.page_id, p.box_id, p.position, coalesce(arg_min(s.column_name, s.ord), 'box' || p.position) as column_name from placed p
left join saved s on abs(p.x - s.x) <= 20 and abs(p.y - s.y) <= 20 group by p.page_id, p.box_id, p.position""")  # fmt: skip
def saved_mapping_match(spark, d):
    return mp.match_saved(*_saved(spark, d))


@query("detail_export", BOXES_SQL, "select page_id, box_id, is_filled, fill_score, x as position_x, y as position_y, w as width, h as height from boxes")
def detail_export(spark, d):
    return mp.detail(fx.plain_boxes(spark, d))


@query("mapping_json", BOXES_SQL, rows_sql("boxes", "box_id"), _SAVED, """select '{' || string_agg('"box' || ord || '":{"column_name":"' || column_name || '","position":{"x":' || x || ',"y":' || y || ',"width":' || width || ',"height":' || height || '},"original_id":' || original_id || ',"fill_score":' || fill_score || '}', ',' order by ord) || '}' as json from saved""")
def mapping_json(spark, d):
    return mp.mapping_json(_saved(spark, d)[1])


@query("named_answers", BOXES_SQL, rows_sql("boxes", "box_id"), "select page_id, box_id, position, case " + " ".join(f"when position = {i + 1} then '{n}'" for i, n in enumerate(ANSWER_NAMES)) + " else 'box' || position end as column_name from placed")
def named_answers(spark, d):
    return mp.name_by_list(spark, bx.row_order(fx.plain_boxes(spark, d)), ANSWER_NAMES).select("page_id", "box_id", "position", "column_name")
