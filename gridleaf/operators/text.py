"""OCR words to lines, categories and label filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import category, clean

LINE_KEYS = ("page_id", "line_num")


def valid_words(words: DataFrame) -> DataFrame:
    """Words of positive confidence that are not blank."""
    return words.where("confidence > 0 and trim(text) <> ''")


def assemble_lines(words: DataFrame, keys: tuple[str, ...] = LINE_KEYS) -> DataFrame:
    """Lines of valid words: text in x order, bounding box, centre, mean confidence, word_count."""
    order = F.array_sort(F.collect_list(F.struct("x", "word_num", "text")))
    out = valid_words(words).groupBy(*keys).agg(
        F.array_join(F.transform(order, lambda e: e["text"]), " ").alias("text"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.expr("max(x + w) - min(x)").alias("w"), F.expr("max(y + h) - min(y)").alias("h"),
        F.expr("(min(x) + max(x + w)) div 2").alias("cx"), F.expr("(min(y) + max(y + h)) div 2").alias("cy"), F.avg("confidence").alias("confidence"), F.count("*").alias("word_count"),
    )
    return out


def categorise(lines: DataFrame) -> DataFrame:
    return lines.withColumn("category", category(F.col("text"), F.col("confidence")))


def category_counts(lines: DataFrame) -> DataFrame:
    """Form structure of each page: regions, questions, options, other texts."""
    c = categorise(lines)
    return c.groupBy("page_id").agg(F.count("*").alias("total_regions"), *(F.count_if(F.col("category") == k).alias(f"{k}_count") for k in ("question", "option", "other")), F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def label_filter(lines: DataFrame, min_confidence: float = 50, min_length: int = 2) -> DataFrame:
    return lines.withColumn("cleaned_text", clean(F.col("text"))).where((F.col("confidence") >= min_confidence) & (F.length("cleaned_text") >= min_length))


def label_pool(lines: DataFrame) -> DataFrame:
    """Options and other texts of a page; all its lines where it has neither."""
    c = categorise(lines)
    usable = c.groupBy("page_id").agg(F.max((F.col("category") != "question").cast("int")).alias("some"))
    return c.join(usable, "page_id").where("category <> 'question' or some = 0").drop("some")
