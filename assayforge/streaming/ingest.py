"""Record ingestion and issue rules over file streams.

Batch operators that need the whole dataset (groups, leakage, splits) stay batch;
what is decided row by row, and duplicates of a key within a watermark, can run
as files arrive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayforge.functions import text
from assayforge.operators import audit


def record_stream(spark: SparkSession, folder: str, columns: list[str], structure: str, sep: str = ",", files_per_batch: int = 16) -> DataFrame:
    """Rows of delimited files as they arrive, every cell text, with status."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.readStream.schema(schema).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    s = F.col(f"`{structure}`")
    status = F.when(text.is_empty_structure(s), "empty").when(text.has_inner_space(s), "invalid").otherwise("ok")
    return rows.withColumn("status", status).withColumn("arrived", F.current_timestamp())


def issue_counts(stream: DataFrame, conditions: dict, window: str = "1 minute", late: str = "10 minutes", time: str = "arrived") -> DataFrame:
    """(window, code, n) of conditions that hold, with late rows up to a watermark."""
    codes = stream.withWatermark(time, late).select(time, F.explode(audit.flags(conditions)).alias("code"))
    return codes.groupBy(F.window(time, window), "code").agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, key: str, late: str = "10 minutes", time: str = "arrived") -> DataFrame:
    """The stream without later rows of a key seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Runs a batch operator on what each trigger brings, then stops when there is no more."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
