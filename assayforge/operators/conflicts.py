"""Conflicting labels of records that share a key and a context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions import measure


def upper_median(values: Column) -> Column:
    """Of an array: the middle one, the upper of two."""
    return F.try_element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def is_quantitative(records: DataFrame, value: str) -> DataFrame:
    """One row: whether all non-empty values read as measurements."""
    text = F.trim(F.col(value).cast("string"))
    return records.where(F.coalesce(text, F.lit("")) != "").agg(F.coalesce(F.bool_and(measure.is_measurement(text)), F.lit(False)).alias("quantitative"))


def missing_units(records: DataFrame, value: str, units: str) -> DataFrame:
    """Measurements without units, grouped or not."""
    return records.where(measure.is_measurement(F.trim(F.col(value).cast("string"))) & (F.coalesce(F.trim(units), F.lit("")) == ""))


def by_class(records: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Groups of two records or more: n_records, n_labels, conflict."""
    text = F.trim(F.col(label).cast("string"))
    rows = records.where(F.coalesce(text, F.lit("")) != "").select(*keys, text.alias("_label"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("n_records"), F.count_distinct("_label").alias("n_labels")).where("n_records >= 2")
    return found.withColumn("conflict", F.col("n_labels") > 1)


def label_counts(records: DataFrame, keys: list[str], label: str) -> DataFrame:
    """How often each label occurs in each group."""
    return records.groupBy(*keys, F.trim(F.col(label).cast("string")).alias("label")).agg(F.count("*").alias("n"))


def by_value(records: DataFrame, keys: list[str], parsed: str, tolerance: float, digits: int | None = 4) -> DataFrame:
    """Groups of two records or more by the parsed measurement column.

    Exact, comparable values are compared on the logarithmic molar scale if all
    have one, else as they are if they share a unit; otherwise there is no
    spread. A spread beyond the tolerance is a conflict. The spread is rounded to
    ``digits`` before that; None leaves it as it is.
    """
    m = F.col(parsed)
    exact = m["comparable"] & ~m["censored"] & m["value"].isNotNull()
    rows = records.select(*keys, m.alias("m"), exact.alias("exact"))
    log, value = F.when(F.col("exact"), F.col("m.log_value")), F.when(F.col("exact"), F.col("m.value"))
    unit = F.when(F.col("exact"), F.lower("m.units"))
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("n_records"), F.count_if("exact").alias("n_exact"), F.count_if(F.col("m.censored")).alias("n_censored"),
        F.count(log).alias("_logs"), F.count_distinct(unit).alias("_units"),
        (F.max(log) - F.min(log)).alias("_log_spread"), (F.max(value) - F.min(value)).alias("_spread"),
    ).where("n_records >= 2")
    molar = (F.col("_logs") > 0) & (F.col("_logs") == F.col("n_exact"))
    scale = F.when(molar, "log10 molar").when((F.col("_units") == 1), "absolute").when((F.col("_units") == 0) & (F.col("n_exact") > 0), "absolute (unitless)")
    spread = F.when(F.col("n_exact") >= 2, F.when(molar, F.col("_log_spread")).when(F.col("_units") <= 1, F.col("_spread")))
    found = found.withColumn("scale", scale).withColumn("spread", spread if digits is None else F.bround(spread, digits))
    return found.withColumn("conflict", F.coalesce(F.col("spread") > tolerance, F.lit(False))).select(*keys, "n_records", "n_exact", "n_censored", "scale", "spread", "conflict")


def replicates(records: DataFrame, keys: list[str], source: str, value: str) -> DataFrame:
    """Disagreement within sources and between them.

    Per group: sources, sources with several values, their records, the largest
    spread within one, and the spread of the sources' upper medians.
    """
    one = records.where(F.col(value).isNotNull() & (F.coalesce(F.trim(F.col(source).cast("string")), F.lit("")) != "")).groupBy(*keys, source)
    one = one.agg(F.count("*").alias("n"), (F.max(value) - F.min(value)).alias("spread"), upper_median(F.collect_list(value)).alias("middle"))
    several = F.col("n") > 1
    return one.groupBy(*keys).agg(
        F.count("*").alias("n_sources"), F.count_if(several).alias("n_technical_groups"), F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("n_technical_records"),
        F.max(F.when(several, F.col("spread"))).alias("technical_spread"),
        F.when(F.count("*") > 1, F.max("middle") - F.min("middle")).alias("between_source_spread"),
    )
