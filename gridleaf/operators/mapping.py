"""Column names of boxes: saved mappings, name lists, detail rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOLERANCE = 20
MAPPING_ROWS = 100_000


def saved_mapping(ordered: DataFrame, shift: int = 0) -> DataFrame:
    """(ord, column_name, x, y, width, height, original_id, fill_score) from one page's ordered boxes."""
    return ordered.select(F.col("position").alias("ord"), F.concat(F.lit("q"), F.col("position").cast("string")).alias("column_name"), (F.col("x") + shift).alias("x"), (F.col("y") + shift).alias("y"), F.col("w").alias("width"), F.col("h").alias("height"), F.col("box_id").alias("original_id"), "fill_score")


def match_saved(ordered: DataFrame, mapping: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Each box's name: that of the first saved box within the tolerance on both axes, else box{position}.

    Boxes and saved boxes join on grid cells of the tolerance; a mapping is broadcast only
    within a checked size.
    """
    rows = mapping.select(F.col("ord"), "column_name", F.col("x").alias("mx"), F.col("y").alias("my"))
    near = f"abs(x - mx) <= {tolerance} and abs(y - my) <= {tolerance}"
    cells = rows.withColumns({"gx": F.floor(F.col("mx") / tolerance), "gy": F.floor(F.col("my") / tolerance)})
    if rows.count() <= MAPPING_ROWS:
        cells = F.broadcast(cells)
    around = F.array(F.lit(-1), F.lit(0), F.lit(1))
    each = ordered.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumns({"cx_": F.floor(F.col("x") / tolerance) + F.col("i"), "cy_": F.floor(F.col("y") / tolerance) + F.col("j")})
    pairs = each.join(cells, F.expr(f"gx = cx_ and gy = cy_ and {near}"), "left")
    best = pairs.groupBy("page_id", "box_id", "position").agg(F.min_by("column_name", "ord").alias("found"))
    return best.select("page_id", "box_id", "position", F.coalesce("found", F.concat(F.lit("box"), F.col("position").cast("string"))).alias("column_name"))


def name_by_list(spark: SparkSession, ordered: DataFrame, names: list[str]) -> DataFrame:
    """Names by position; box{position} beyond the list. Two equal names are refused."""
    if len(set(names)) != len(names):
        raise ValueError("answer names repeat")
    table = F.broadcast(spark.createDataFrame([(i + 1, n) for i, n in enumerate(names)], "position long, given string"))
    return ordered.join(table, "position", "left").withColumn("column_name", F.coalesce("given", F.concat(F.lit("box"), F.col("position").cast("string")))).drop("given")


def detail(boxes: DataFrame) -> DataFrame:
    return boxes.select("page_id", "box_id", "is_filled", "fill_score", F.col("x").alias("position_x"), F.col("y").alias("position_y"), F.col("w").alias("width"), F.col("h").alias("height"))


def mapping_json(mapping: DataFrame) -> DataFrame:
    """One row: the mapping as a JSON object boxN -> column_name, position, original_id, fill_score."""
    entry = F.struct("ord", F.struct("column_name", F.struct("x", "y", "width", "height").alias("position"), "original_id", "fill_score").alias("v"))
    rows = F.array_sort(F.collect_list(entry))
    as_map = F.map_from_entries(F.transform(rows, lambda e: F.struct(F.concat(F.lit("box"), e["ord"].cast("string")), e["v"])))
    return mapping.agg(F.to_json(as_map).alias("json"))


def reference(named: DataFrame) -> DataFrame:
    """The reference table of a mapping: box number, name, place, state."""
    return named.select("page_id", F.concat(F.lit("box"), F.col("position").cast("string")).alias("box_number"), "column_name", F.col("x").alias("position_x"), F.col("y").alias("position_y"), "is_filled", "fill_score")


def simple_json(mapping: DataFrame) -> DataFrame:
    """One row: the mapping of one form as a JSON object boxN -> column_name."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "column_name")))
    as_map = F.map_from_entries(F.transform(rows, lambda e: F.struct(F.concat(F.lit("box"), e["ord"].cast("string")), e["column_name"])))
    return mapping.agg(F.to_json(as_map).alias("json"))


def custom_wide(ordered: DataFrame, names: list[str], order: list[str] | None = None) -> DataFrame:
    """One row a page with a boolean column for each name, by position; order picks and orders the columns. Names that repeat are refused."""
    if len(set(names)) != len(names):
        raise ValueError("answer names repeat")
    at = {n: i + 1 for i, n in enumerate(names)}
    columns = [n for n in order if n in at] if order else names
    return ordered.groupBy("page_id").agg(*(F.max(F.when(F.col("position") == at[n], F.col("is_filled"))).alias(n) for n in columns))


def files_and_pages(files: DataFrame, pages: list[int] | None) -> DataFrame:
    """files (seq, path) with page numbers: none means page 0, one holds for all, else pairs in order (the shorter list ends)."""
    if not pages:
        return files.withColumn("page", F.lit(0))
    if len(pages) == 1:
        return files.withColumn("page", F.lit(pages[0]))
    return files.where(F.col("seq") < len(pages)).withColumn("page", F.get(F.array(*map(F.lit, pages)), F.col("seq").cast("int")))
