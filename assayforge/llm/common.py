"""Reading the corpus tables, cutting lineage, and the memory of Arrow batches and workers."""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Rows of whole texts in an Arrow batch, at most.
BATCH_ROWS = 2000
#: Rows of whole texts in a file, about, where there are more than a few files for each core.
FILE_ROWS = 5000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the folder the cluster names in spark.checkpoint.dir.

    Only where that setting is missing (tests on one machine) a folder is made.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", "") or ""
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def spread(spark: SparkSession, rows: int, each: int = FILE_ROWS) -> int:
    """Partitions in which so many rows are written: enough to keep all cores busy, and no more
    than that for few rows.

    On a local file system without Hadoop's native library each file costs the executor
    processes that set its mode, and while one starts it counts with all of the executor's memory.
    """
    return max(4 * spark.sparkContext.defaultParallelism, -(-rows // each))


def _freed(run: Callable) -> Callable:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        # Workers outlive their tasks; what these have freed would stay theirs.
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


def map_texts(df: DataFrame, run: Callable, schema: StructType | str) -> DataFrame:
    """``df.mapInArrow`` for rows with whole texts: batches of at most ``BATCH_ROWS`` rows, and
    workers that give memory back after each task.

    Spark takes the size of a batch from the session when the plan runs, so it is set there;
    a smaller one stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(key)) <= BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(_freed(run), schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
