"""Ranked similarity search, pattern search, batch filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions.numbering import numbered


def similar(library: DataFrame, similarity: Column, threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """Library rows at the threshold or above, most similar first, input order on ties, ranked from 1."""
    found = library.withColumn("similarity", similarity).where(F.col("similarity") >= threshold)
    order = [F.desc("similarity"), F.asc("position")]
    if top is not None:
        found = found.orderBy(*order).limit(top)
    return numbered(found, order, "rank").withColumn("rank", F.col("rank") + 1)


def matching(library: DataFrame, matched: Column) -> DataFrame:
    """Rows that a pattern matches."""
    return library.where(F.coalesce(matched, F.lit(False)))


def batch_filter(rows: DataFrame, passed: Column, failing: bool = False) -> DataFrame:
    """Rows that pass, or with ``failing`` those that do not."""
    ok = F.coalesce(passed, F.lit(False))
    return rows.where(~ok if failing else ok)


def exploded(rows: DataFrame, array: str, name: str) -> DataFrame:
    """One row per element; rows without any stay, with a null."""
    return rows.withColumn(name, F.explode_outer(array)).drop(array)
