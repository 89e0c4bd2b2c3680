"""Pages as a stream of files. A page is complete when it arrives and never meets another one, so no state crosses batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from foliant.operators.lines import word_boxes
from foliant.shared import new_path
from foliant.sources.glyphs import glyphs_of


def page_stream(spark: SparkSession, folder: str, files: str, schema: StructType, per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files under ``folder`` whose names fit ``files``, as they arrive."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).option("maxFilesPerTrigger", per_batch).parquet(folder)


def run_pages(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, *, trigger: dict | None = None):
    """Apply ``work`` to each batch of whole pages and write it under its batch number, so that a repeated batch replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def words_of_stream(stream: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """Word boxes of all pages that are there now: one run to the end of the stream."""
    spark, out = stream.sparkSession, new_path(stream.sparkSession, "stream")
    words = lambda texts: word_boxes(glyphs_of(texts, id_col, text_col).withColumn("line_id", F.col("line_no")))
    run_pages(stream, words, f"{out}/words", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/words").drop("batch")
