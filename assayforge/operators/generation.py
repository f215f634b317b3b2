"""Generated records: validity, uniqueness, novelty, diversity, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions import text


def validity(records: DataFrame, structure: str, parsed: Column | None = None) -> DataFrame:
    """Records with ``reason``: null if valid, else empty, whitespace or unparseable."""
    c = F.col(structure)
    reason = F.when(text.is_empty_structure(c), "empty").when(text.has_inner_space(c), "whitespace")
    if parsed is not None:
        reason = reason.when(parsed.isNull(), "unparseable")
    return records.withColumn("reason", reason)


def uniqueness(records: DataFrame, level: str) -> DataFrame:
    """Valid records with the first record of their key where that is another one."""
    first = records.where(F.col(level).isNotNull()).groupBy(level).agg(F.min_by("record_id", "position").alias("_first"))
    return records.join(first, level, "left").withColumn("duplicate_of", F.when(F.col("_first") != F.col("record_id"), F.col("_first"))).drop("_first")


def novelty(generated: DataFrame, reference: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """One row a level: unique keys, and those that the reference lacks."""
    out = None
    for k in levels:
        mine = generated.where(F.col(k).isNotNull()).select(F.col(k).alias("key")).distinct()
        known = reference.where(F.col(k).isNotNull()).select(F.col(k).alias("key")).distinct().withColumn("known", F.lit(1))
        one = mine.join(known, "key", "left").agg(F.count("*").alias("n_unique"), F.count_if(F.col("known").isNull()).alias("n_novel")).select(F.lit(k).alias("level"), "n_unique", "n_novel")
        out = one if out is None else out.unionByName(one)
    return out


def report(generated: DataFrame, level: str) -> DataFrame:
    """One row: records, valid ones, unique valid ones."""
    valid = F.col("reason").isNull() & F.col(level).isNotNull()
    return generated.agg(F.count("*").alias("n"), F.count_if(valid).alias("n_valid"), F.count_distinct(F.when(valid, F.col(level))).alias("n_unique"))


def top_alerts(alerts: DataFrame, name: str, n: int = 20) -> DataFrame:
    """The alerts that most records have."""
    return alerts.groupBy(name).agg(F.count_distinct("record_id").alias("n_records")).orderBy(F.desc("n_records"), name).limit(n)


def diversity(neighbours: DataFrame) -> DataFrame:
    """Least, upper median and most of the nearest-neighbour similarities."""
    values = neighbours.groupBy("similarity").agg(F.count("*").alias("c"))
    from pyspark.sql import Window

    run = values.withColumn("upto", F.sum("c").over(Window.orderBy("similarity"))).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return run.agg(F.min("similarity").alias("least"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("similarity"))).alias("middle"), F.max("similarity").alias("most"))
