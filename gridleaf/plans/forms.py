"""The two whole flows: the answer row of a form, and the labelled survey of a page.

    python -m gridleaf.plans.forms BOXES.parquet OUT [--width 1700 --height 2200 --top 10 --bottom 5]
    python -m gridleaf.plans.forms FOLDER OUT --scan [--pattern *.png --page 0 --dpi 200 --top 10 --bottom 5]
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fill as fills
from ..operators import boxes as bx
from ..operators import correlate as co
from ..operators import text as tx
from ..operators import vision as vi
from ..sources import readers, sinks


@dataclass(frozen=True)
class Settings:
    """Parameters of a scan; the presets are common choices."""

    dpi: int = 200
    min_side: int = 20
    max_side: int = 40
    language: str = "eng"


#: Presets of dpi, side range and OCR language.
PRESETS = {"default": Settings(), "high_resolution": Settings(300, 30, 60), "small_boxes": Settings(200, 10, 25)}


def _page_id() -> Column:
    return F.xxhash64("path", "page").alias("page_id")


def logger(debug: bool = False, name: str = "gridleaf") -> logging.Logger:
    """The flows' logger: one handler however often it is asked for, details only if debug."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(asctime)s %(name)s %(levelname)s %(message)s"))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel(logging.DEBUG if debug else logging.INFO)
    return log


def detected(files: DataFrame, folder: str, settings: Settings = Settings(), render=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(boxes, rasters, errors) of scanned files (path, content[, page]); boxes carry fill_score and is_filled.

    Pages are rendered once and kept in folder as a table; page_id is a hash of file and page. A page
    that can't be rendered is a row of errors (page_id, path, page, error) and ends nothing.
    """
    rasters = readers.rasterise(files, render, settings.dpi)
    rasters.select(_page_id(), "*").write.mode("overwrite").parquet(folder)
    rasters = files.sparkSession.read.parquet(folder)
    errors = rasters.where("error is not null").select("page_id", "path", "page", "error")
    rasters = rasters.where("error is null")
    good = rasters.drop("path", "page", "error")
    sides = (settings.min_side, settings.max_side)
    boxes = vi.detect_checkboxes(good, sides, sides)
    scored = fills.rule_vote(vi.box_features(boxes.join(good, "page_id"))).select("page_id", "box_id", F.col("filled_score").alias("fill_score"), "is_filled")
    return boxes.join(scored, ["page_id", "box_id"]), rasters, errors


def answers_from_files(files: DataFrame, folder: str, settings: Settings = Settings(), top_percent: float = 10, bottom_percent: float = 5, render=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(wide answer rows with path and page, the boxes they come from, errors) of scanned files.

    Boxes in the top and bottom share of their own page's height are left out.
    """
    boxes, rasters, errors = detected(files, folder, settings, render)
    top, bottom = (F.expr(f"cast(floor(height * {p}D / 100) as int)") for p in (top_percent, bottom_percent))
    regions = F.array(F.struct(F.lit(0).alias("y1"), top.alias("y2")), F.struct((F.col("height") - bottom).alias("y1"), F.col("height").alias("y2")))
    regions = rasters.select("page_id", F.lit(0).alias("x1"), F.col("width").alias("x2"), F.inline(regions))
    kept, _ = bx.split_excluded(boxes, regions)
    wide = bx.answers_of(kept)
    return rasters.select("page_id", "path", "page").join(wide, "page_id").drop("page_id"), kept, errors


def from_files(files: DataFrame, words: DataFrame, folder: str, settings: Settings = Settings(), render=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(items, metadata, documents, errors) of scanned files (path, content[, page]) and their OCR words.

    words: (path, page, line_num, word_num, text, x, y, w, h, confidence). Pages and errors are
    those of ``detected``.
    """
    boxes, _, errors = detected(files, folder, settings, render)
    lines = tx.assemble_lines(words.withColumn("page", F.col("page").cast("int")).select(_page_id(), *(c for c in words.columns if c not in ("path", "page"))))
    number = F.row_number().over(Window.partitionBy("page_id").orderBy("line_num")).cast("long") - 1
    return (*survey(boxes, lines.withColumn("text_id", number)), errors)


def survey(boxes: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, metadata, documents) of pages from detected boxes and OCR lines with text_id."""
    pool = tx.label_pool(lines)
    items = co.survey_items(boxes, pool, co.adaptive_match(boxes, pool))
    metadata = co.survey_metadata(items)
    return items, metadata, sinks.page_documents(items, metadata)


def main(args: list[str] | None = None, render=None) -> None:
    p = argparse.ArgumentParser(description="Wide answer rows of detected boxes or of scanned files")
    p.add_argument("boxes", help="a table of boxes, or with --scan a folder of scans")
    p.add_argument("out")
    for name, value in (("width", 1700), ("height", 2200), ("top", 10), ("bottom", 5), ("page", 0), ("dpi", 200)):
        p.add_argument(f"--{name}", type=int, default=value)
    p.add_argument("--scan", action="store_true", help="detect the boxes; rendered pages are kept in OUT_pages")
    p.add_argument("--pattern", default="*", help="file names to read with --scan")
    p.add_argument("--debug", action="store_true")
    a = p.parse_args(args)
    log = logger(a.debug)
    spark = SparkSession.builder.appName("forms").getOrCreate()
    if a.scan:
        files = readers.scans(spark, a.boxes, a.pattern).withColumn("page", F.lit(a.page))
        wide, boxes, errors = answers_from_files(files, f"{a.out}_pages", Settings(dpi=a.dpi), a.top, a.bottom, render)
        log.info("%d pages could not be rendered", errors.count())
    else:
        boxes = spark.read.parquet(a.boxes)
        wide = bx.answers(boxes, a.width, a.height, a.top, a.bottom)
    sinks.write_csv(wide, a.out)
    s = boxes.agg(F.count("*").alias("n"), F.count_if("is_filled").alias("filled")).first()
    log.debug("answers are in %s", a.out)
    print(f"{s['n']} boxes, {s['filled']} filled; answers in {a.out}")


if __name__ == "__main__":
    main()
