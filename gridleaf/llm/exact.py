"""Operator 2: skew-safe exact deduplication.

1. Each task merges its equal texts (partial aggregation keyed by the full text).
2. Merged rows meet by (digest, salt, full text); only digests that hold a counted
   large share of all rows are salted, so all others are final here.
3. Winners of the salts of a hot digest meet by (digest, full text).

The full normalised text is a key of every merge, so a digest collision never joins
two texts. Rows then find their class by digest, and by digest and full text where
one digest has several texts.

Defined cases: null text counts as empty. Rows with a null id take part; ids sort
before null, and a group of null ids alone has a null keep_id and keeps all its rows.
Rows that repeat an id and a text count in group_size and share one decision.
An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, hot_join, least_id, numbered, saved, table, without_rows

SALTS = 64


def normalised(text: str = "text") -> F.Column:
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("id"), normalised(text_col).alias("norm")).withColumn("digest", F.sha2("norm", 256))
    ids = saved(rows.select("id", "digest"), "digests")
    total = ids.count()
    hot = ids.groupBy("digest").count().where(F.col("count") * HOT_SHARE > max(total, HOT_SHARE)).select("digest", F.lit(True).alias("hot"))
    hot = saved(hot, "hot")  # at most HOT_SHARE rows by construction
    salted = rows.join(F.broadcast(hot), "digest", "left").select("id", "norm", "digest", F.coalesce("hot", F.lit(False)).alias("hot"))
    salted = salted.withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    merged = salted.groupBy("digest", "salt", "hot", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("n"))
    # the text itself goes on only where salts must still meet
    merged = saved(merged.select("digest", "hot", "keep_id", "n", F.when(F.col("hot"), F.col("norm")).alias("norm")), "merged")
    whole = merged.where("not hot").select("digest", "keep_id", F.col("n").alias("group_size"))
    joined = merged.where("hot").groupBy("digest", "norm").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")).drop("norm")
    classes = saved(whole.unionByName(joined), "classes")
    several = saved(classes.groupBy("digest").count().where("count > 1").select("digest"), "several")
    found = hot_join(ids, classes, ["digest"], hot)
    if not several.isEmpty():  # one digest of two texts: those rows find their class by the whole text
        full = rows.join(several, "digest", "left_semi")
        by_text = full.groupBy("digest", "norm").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
        found = found.join(several, "digest", "left_anti").unionByName(full.join(by_text, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of equal texts one row stays, of the least doc_id (null after all others); of rows that repeat, one."""
    rows, row = numbered(docs)
    found = exact_dedup(rows.select(least_id("doc_id", row).alias("id"), "text"), "id")
    return without_rows(rows, row, found.where("not kept").select("id.row"))


SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
g as (select norm, min(doc_id) as keep_id, count(*) as group_size from d group by norm)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id = g.keep_id as kept, sha256(d.norm) as text_sha256
from d join g using (norm)
"""
