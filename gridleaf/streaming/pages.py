"""Extension: the form flow over a folder that detected boxes drop into, as a stream.

Pages are whole in their file, so each micro-batch runs the batch operators on its own
pages; a page's time bounds the state of the running summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boxes as bx

BOXES = "page_id long, box_id long, x long, y long, w long, h long, fill_score double, is_filled boolean, seen_at timestamp"


def box_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(BOXES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def fill_rates(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Boxes and filled boxes by time window; windows close when the watermark passes."""
    return stream.withWatermark("seen_at", late).groupBy(F.window("seen_at", window).alias("w")).agg(F.count("*").alias("total"), F.count_if("is_filled").alias("filled")).select("w.start", "w.end", "total", "filled")


def write_answers(stream: DataFrame, out: str, checkpoint: str, width: int, height: int):
    """Wide answer rows of each batch's pages, appended as Parquet; a replayed batch overwrites its own folder."""

    def one(batch: DataFrame, epoch: int) -> None:
        bx.answers(batch.drop("seen_at"), width, height).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
