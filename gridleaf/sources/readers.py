"""Sources: scanned files, OCR word tables, saved mappings, requests of pages."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the OCR engine's word table.
WORD_TABLE = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left long, top long, width long, height long, conf double, text string"
MAPPING = "map<string, struct<column_name:string,position:struct<x:bigint,y:bigint,width:bigint,height:bigint>,original_id:bigint,fill_score:double>>"
RASTER = "path string, page int, height int, width int, channels int, data binary, error string"


def scans(spark: SparkSession, folder: str, pattern: str = "*.pdf") -> DataFrame:
    """Files by glob: path, length, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def requested_pages(files: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with their file, requests of missing files) for requests (name, page)."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return requests.join(named, "name"), requests.join(named, "name", "left_anti")


def portable_image(content: bytes) -> tuple[int, int, int, bytes]:
    """Rows, columns, channels and bytes of a binary PGM or PPM image."""
    if content[:2] not in (b"P5", b"P6"):
        raise ValueError("not an 8-bit PGM or PPM image")
    parts, at = [], 0
    while len(parts) < 4:
        if at >= len(content):
            raise ValueError("the image ends early")
        while content[at : at + 1].isspace():
            at += 1
        if content[at : at + 1] == b"#":
            at = content.index(b"\n", at)
            continue
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        parts.append(content[at:end])
        at = end
    kinds = {b"P5": 1, b"P6": 3}
    if parts[0] not in kinds or int(parts[3]) != 255:
        raise ValueError("not an 8-bit PGM or PPM image")
    w, h, c = int(parts[1]), int(parts[2]), kinds[parts[0]]
    data = content[at + 1 : at + 1 + w * h * c]
    if len(data) != w * h * c:
        raise ValueError("the image ends early")
    return h, w, c, data


def png_image(content: bytes) -> tuple[int, int, int, bytes]:
    """Rows, columns, channels (1 or 3) and bytes of an 8-bit PNG image without interlace; an alpha channel is dropped."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, raw, head, palette = 8, b"", None, None
    while at < len(content):
        size, kind = int.from_bytes(content[at : at + 4], "big"), content[at + 4 : at + 8]
        part = content[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            raw += part
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only 8-bit PNG images without interlace are read")
    w, h, _, colour = head[:4]
    bpp = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), np.uint8)
    above = np.zeros(w * bpp, np.uint8)
    for y in range(h):
        above = out[y] = _unfiltered(int(rows[y, 0]), rows[y, 1:], above, bpp)
    px = out.reshape(h, w, bpp)
    px = palette[px[:, :, 0]] if colour == 3 else px[:, :, : 3 if colour in (2, 6) else 1]
    return h, w, px.shape[2], px.tobytes()


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    """One row of a PNG image from its filtered bytes and the row above."""
    if kind == 0:
        return line
    if kind == 2:
        return line + above
    if kind == 1:  # sums along the row, for each channel
        return np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    if kind not in (3, 4):
        raise ValueError("not a PNG filter")
    out, up = [0] * len(line), above.tolist()
    for i, v in enumerate(line.tolist()):
        a, b = out[i - bpp] if i >= bpp else 0, up[i]
        if kind == 3:
            guess = (a + b) // 2
        else:
            c = up[i - bpp] if i >= bpp else 0
            guess = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
        out[i] = (v + guess) & 255
    return np.array(out, np.uint8)


def any_image(content: bytes) -> tuple[int, int, int, bytes]:
    """A PNG, PGM or PPM image."""
    return png_image(content) if content[:4] == b"\x89PNG" else portable_image(content)


def rasterise(files: DataFrame, render: Callable[[bytes, int, int], tuple[int, int, int, bytes]] | None = None, dpi: int = 200) -> DataFrame:
    """Rasters of files (path, content[, page]): render(content, page, dpi) -> height, width, channels, bytes.

    Only the requested pages are rendered. The default renderer reads PNG, PGM and PPM images; one
    for PDF needs a library that is not part of this package. A failed page has an error
    text and no data.
    """
    draw = render or (lambda content, page, dpi: any_image(content))
    rows = files if "page" in files.columns else files.withColumn("page", F.lit(0))

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    out.append((r.path, r.page, *draw(r.content, r.page, dpi), None))
                except Exception as e:
                    out.append((r.path, r.page, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in RASTER.split(", ")]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})

    return rows.select("path", F.col("page").cast("int").alias("page"), "content").mapInPandas(run, RASTER)


def ocr_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of tab-separated OCR tables, with confidence and box; the file is the page's source."""
    raw = spark.read.option("sep", "\t").option("header", "true").option("quote", "").schema(WORD_TABLE).csv(path).withColumn("path", F.input_file_name())
    return raw.select("path", F.col("page_num").cast("long").alias("page_id"), "level", "block_num", "par_num", "line_num", "word_num", "text", F.col("left").alias("x"), F.col("top").alias("y"), F.col("width").alias("w"), F.col("height").alias("h"), F.col("conf").cast("int").alias("confidence"))


def recognised_words(rasters: DataFrame, engine: Callable[[bytes, int, int, int, str, int], list[tuple]], language: str = "eng", layout: int = 6) -> DataFrame:
    """Words of raster pages by an OCR engine, run on executors: engine(data, height, width, channels, language, layout)
    gives (block_num, par_num, line_num, word_num, x, y, w, h, confidence, text) for each word. A page that fails has none."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    out += [(r.page_id, *word) for word in engine(r.data, r.height, r.width, r.channels, language, layout)]
                except Exception:
                    continue
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _WORDS.split(", ")])

    return rasters.select("page_id", "height", "width", "channels", "data").mapInPandas(run, _WORDS)


_WORDS = "page_id long, block_num long, par_num long, line_num long, word_num long, x long, y long, w long, h long, confidence int, text string"


def saved_mapping(spark: SparkSession, path: str) -> DataFrame | None:
    """(ord, column_name, x, y, width, height, original_id, fill_score) of a mapping file; None if it is missing."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", MAPPING)).alias("k", "v"))
    return rows.select(F.regexp_extract("k", r"(\d+)$", 1).cast("long").alias("ord"), "v.column_name", "v.position.*", "v.original_id", "v.fill_score")
