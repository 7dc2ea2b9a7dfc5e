"""Sinks: JSON documents, CSV tables, mapping files, and drawing commands for annotated pages."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import confidence_colour, short_label


def page_documents(items: DataFrame, metadata: DataFrame) -> DataFrame:
    """(page_id, json): metadata and items of each page as one document. Infinite distances are the string "Infinity"."""
    fields = [c for c in items.columns if c != "page_id"]
    lists = items.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("item_id", *(c for c in fields if c != "item_id")))).alias("survey_items"))
    meta = metadata.select("page_id", F.struct(*(c for c in metadata.columns if c != "page_id")).alias("metadata"))
    return meta.join(lists, "page_id").select("page_id", F.to_json(F.struct(F.struct("survey_items", "metadata").alias("survey_data"))).alias("json"))


def write_json(documents: DataFrame, path: str) -> None:
    documents.select("json").write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def output_name(path: Column, page: Column, at: Column) -> Column:
    """{file without folder and suffix}_page{n}_{time}."""
    base = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat_ws("_", base, F.concat(F.lit("page"), page.cast("string")), F.date_format(at, "yyyyMMdd_HHmmss"))


def _command(page: str, shape: str, colour: Column, label: Column) -> list[Column]:
    return [F.col(page), F.lit(shape).alias("shape"), "x", "y", "w", "h", colour.alias("colour"), label.alias("label")]


def draw_boxes(boxes: DataFrame) -> DataFrame:
    """Filled boxes green, empty ones red, numbered from 1."""
    return boxes.select(*_command("page_id", "rectangle", F.when(F.col("is_filled"), "green").otherwise("red"), F.concat(F.lit("box"), (F.col("box_id") + 1).cast("string"))))


def draw_texts(lines: DataFrame) -> DataFrame:
    return lines.select(*_command("page_id", "rectangle", confidence_colour(F.col("confidence")), short_label(F.col("text"))))


def draw_links(items: DataFrame, texts: DataFrame) -> DataFrame:
    """Lines from matched boxes to their texts, coloured by confidence."""
    c = F.col("confidence")
    colour = F.when(c > 0.7, "green").when(c > 0.3, "yellow").otherwise("red")
    t = texts.select("page_id", "text_id", F.col("cx").alias("to_x"), F.col("cy").alias("to_y"))
    return items.where("text_id is not null").join(t, ["page_id", "text_id"]).select("page_id", F.lit("line").alias("shape"), "cx", "cy", "to_x", "to_y", colour.alias("colour"))


def png_bytes(height: int, width: int, channels: int, data: bytes) -> bytes:
    """An 8-bit gray or colour raster as a PNG image."""
    rows = np.frombuffer(data, np.uint8).reshape(height, width * channels)
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rows], 1).tobytes()
    part = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(kind + x).to_bytes(4, "big")
    head = struct.pack(">IIBBBBB", width, height, 8, {1: 0, 3: 2}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def as_png(rasters: DataFrame) -> DataFrame:
    """(path, page, png) of rasters without an error."""

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([(r.path, r.page, png_bytes(r.height, r.width, r.channels, r.data)) for r in batch.itertuples(index=False)], columns=["path", "page", "png"])

    return rasters.where("error is null").select("path", "page", "height", "width", "channels", "data").mapInPandas(run, "path string, page int, png binary")


def draw_excluded(kept: DataFrame, gone: DataFrame) -> DataFrame:
    """Boxes that an exclusion keeps in green, those that it takes in red."""
    side = lambda df, colour, label: df.select(*_command("page_id", "rectangle", F.lit(colour), F.lit(label)))
    return side(kept, "green", "kept").unionByName(side(gone, "red", "excluded"))


def draw_measured(boxes: DataFrame, most: int = 50) -> DataFrame:
    """The largest boxes of each page with their sides: a figure of `most` at most."""
    area = F.col("w") * F.col("h")
    lists = boxes.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-area).alias("o"), "box_id", "x", "y", "w", "h"))).alias("all"))
    rows = lists.select("page_id", F.explode(F.slice("all", 1, most)).alias("b")).select("page_id", "b.x", "b.y", "b.w", "b.h")
    return rows.select(*_command("page_id", "rectangle", F.lit("blue"), F.concat(F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"))))
