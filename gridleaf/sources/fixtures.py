"""Boxes, text lines, words and rasters derived from the driver's tables.

Every formula is integer or exact, so that SQL gives the same tables. A page is the key
of every table; page images are PAGE_WIDTH x PAGE_HEIGHT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geometry import center_x, center_y

PAGE_WIDTH, PAGE_HEIGHT = 1700, 2200


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """Boxes with the inputs of the rule vote; more: further columns, as of lineitem or of its files (_metadata)."""
    order = Window.partitionBy("page_id").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    raw = read(spark, sf_dir, "lineitem").selectExpr("*", *more).withColumn("page_id", F.col("l_partkey")).withColumn("box_id", F.row_number().over(order).cast("long") - 1)
    return raw.selectExpr(
        "page_id", "box_id",
        "100 + ((l_suppkey * 37) % 12) * 120 + cast(l_quantity as bigint) % 13 as x",
        "150 + (l_orderkey % 20) * 100 + l_linenumber * 4 as y",
        "20 + cast(l_quantity as bigint) % 21 as w",
        "20 + (l_linenumber * 5 + l_orderkey) % 21 as h",
        "round(l_discount * 5 + l_tax * 5, 4) as fill_score",
        "l_discount * 3 as dark_ratio", "l_discount * 2 as contour_area_ratio", "l_tax * 6 as cross_pattern_score", "l_linenumber % 3 as contour_count", "l_tax as edge_density",
        *(c.rsplit(" as ")[-1] for c in more),
    ).withColumn("is_filled", F.col("fill_score") > 0.15)


BOX_COLUMNS = ("page_id", "box_id", "x", "y", "w", "h", "fill_score", "is_filled")


def plain_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(*BOX_COLUMNS)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    raw = read(spark, sf_dir, "orders").withColumn("text_id", F.row_number().over(order).cast("long") - 1)
    return raw.selectExpr(
        "o_custkey as page_id", "text_id", "150 + ((o_orderkey * 37) % 12) * 120 as x", "150 + (o_orderkey % 20) * 100 + o_orderkey % 9 as y",
        "40 + o_orderkey % 60 as w", "18L as h", "o_orderpriority as text", "(o_orderkey * 7) % 101 as confidence",
    ).withColumns({"cx": center_x(), "cy": center_y()})


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OCR word rows of documents: a page is a document, lines part at newlines, words at spaces."""
    lines = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("l", "line"))
    each = lines.select("page_id", (F.col("l") + 1).cast("long").alias("line_num"), F.posexplode(F.split("line", " ")).alias("k", "text"))
    each = each.withColumn("word_num", (F.col("k") + 1).cast("long"))
    return each.selectExpr("page_id", "line_num", "word_num", "text", "60 * word_num as x", "30 * line_num as y", "10L * length(text) as w", "18L as h", "(page_id * 31 + line_num * 7 + word_num * 13) % 101 - 3 as confidence")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 gray patches, row by row."""
    gray = F.transform("embedding", lambda v: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 60 + 215).cast("int"))).cast("long"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("page_id"), gray.alias("pixels"))


# ------------------------------------------------------------- the same tables in SQL

BOXES_SQL = """boxes as (select l_partkey as page_id,
 row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_shipdate) - 1 as box_id,
 100 + ((l_suppkey * 37) % 12) * 120 + cast(l_quantity as bigint) % 13 as x, 150 + (l_orderkey % 20) * 100 + l_linenumber * 4 as y,
 20 + cast(l_quantity as bigint) % 21 as w, 20 + (l_linenumber * 5 + l_orderkey) % 21 as h, round(l_discount * 5 + l_tax * 5, 4) as fill_score,
 l_discount * 3 as dark_ratio, l_discount * 2 as contour_area_ratio, l_tax * 6 as cross_pattern_score, l_linenumber % 3 as contour_count, l_tax as edge_density,
 round(l_discount * 5 + l_tax * 5, 4) > cast(0.15 as double) as is_filled from lineitem),
geo as (select *, x + w // 2 as cx, y + h // 2 as cy, w * h as area, case when h > 0 then cast(w as double) / h else 0 end as aspect_ratio from boxes)"""

TEXTS_SQL = """texts as (select *, x + w // 2 as cx, y + h // 2 as cy from (select o_custkey as page_id, row_number() over (partition by o_custkey order by o_orderkey) - 1 as text_id,
 150 + ((o_orderkey * 37) % 12) * 120 as x, 150 + (o_orderkey % 20) * 100 + o_orderkey % 9 as y, 40 + o_orderkey % 60 as w, cast(18 as bigint) as h,
 o_orderpriority as text, (o_orderkey * 7) % 101 as confidence from orders))"""

WORDS_SQL = """split_lines as (select doc_id as page_id, string_split(text, chr(10)) as ls from documents),
numbered as (select page_id, unnest(range(1, len(ls) + 1)) as line_num, unnest(ls) as line from split_lines),
split_words as (select page_id, line_num, string_split(line, ' ') as ws from numbered),
words as (select *, 60 * word_num as x, 30 * line_num as y, 10 * length(text) as w, 18 as h, (page_id * 31 + line_num * 7 + word_num * 13) % 101 - 3 as confidence
 from (select page_id, line_num, unnest(range(1, len(ws) + 1)) as word_num, unnest(ws) as text from split_words)),
lines as (select page_id, line_num, string_agg(text, ' ' order by word_num) as text, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, avg(confidence) as confidence, count(*) as word_count
 from words where confidence > 0 and trim(text) <> '' group by page_id, line_num)"""

RASTERS_SQL = """rasters as (select cast(vec_id as bigint) as page_id, list_transform(embedding, lambda v: cast(greatest(0, least(255, cast(floor(cast(v as double) * 60 + 215) as int))) as bigint)) as pixels from embeddings),
inner_px as (select page_id, pixels, list_transform([18,19,20,21,26,27,28,29,34,35,36,37,42,43,44,45], lambda i: pixels[i + 1]) as px from rasters)"""
