"""Labelled items of scanned forms, with a report and the batch's summary.

    python examples/survey_report.py SCANS WORDS.parquet OUT [--preset high_resolution]

WORDS has (path, page, line_num, word_num, text, x, y, w, h, confidence), one row a word.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from gridleaf.operators import correlate, quality, vision
from gridleaf.plans import forms
from gridleaf.sources import readers, sinks


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("scans")
    p.add_argument("words")
    p.add_argument("out")
    p.add_argument("--preset", choices=forms.PRESETS, default="default")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("survey_report").getOrCreate()
    log = forms.logger()

    files = readers.scans(spark, a.scans, "*")
    items, metadata, documents, errors = forms.from_files(files, spark.read.parquet(a.words), f"{a.out}/pages", forms.PRESETS[a.preset])
    items.write.mode("overwrite").parquet(f"{a.out}/items")
    items = spark.read.parquet(f"{a.out}/items")
    sinks.write_json(documents, f"{a.out}/documents")

    total = correlate.batch_summary(correlate.survey_metadata(items), errors).first()
    log.info("%d pages, %d failed; %d boxes, %d filled", total.total_files_processed, total.failed, total.total_checkboxes_found, total.total_checkboxes_filled)
    for state, rows in (("filled", items.where("is_filled")), ("empty", items.where("not is_filled"))):
        log.info("%d %s boxes, the first:", rows.count(), state)
        for r in rows.orderBy("page_id", "item_id").limit(5).collect():  # a report shows five
            log.info("  %s (%.2f)", r.label, r.correlation_confidence)
    for r in errors.orderBy("path", "page").limit(20).collect():
        log.warning("%s page %s: %s", r.path, r.page, r.error)
    rasters = spark.read.parquet(f"{a.out}/pages").where("error is null")
    scores = quality.image(vision.image_stats(rasters))
    log.info("mean image score %.3f", scores.agg(F.coalesce(F.avg("score"), F.lit(0.0))).first()[0])


if __name__ == "__main__":
    main()
