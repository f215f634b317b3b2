"""Differences between two versions of a library."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.operators.identity import LEVELS, describe_difference


def diff_libraries(a: DataFrame, b: DataFrame, level: str = "parent") -> DataFrame:
    """(key, count_a, count_b, status, multiplicity_changed) of every key of either side.

    A key of both is unchanged if both have the same set of exact forms. Exact
    forms are counted, not gathered: (key, exact) rows of both sides are matched
    first, then rolled up to keys.
    """
    side = lambda df, n: df.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("key"), F.col("exact").alias("form")).agg(F.count("*").alias(n))
    forms = side(a, "na").join(side(b, "nb"), ["key", "form"], "full_outer")
    found = forms.groupBy("key").agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("count_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("count_b"),
        F.bool_and(F.col("na").isNotNull() & F.col("nb").isNotNull()).alias("same"),
    )
    status = F.when(F.col("count_b") == 0, "removed").when(F.col("count_a") == 0, "added").when(F.col("same"), "unchanged").otherwise("changed")
    both = (F.col("count_a") > 0) & (F.col("count_b") > 0)
    return found.select("key", "count_a", "count_b", status.alias("status"), (both & (F.col("count_a") != F.col("count_b"))).alias("multiplicity_changed"))


def change_phrases(a: DataFrame, b: DataFrame, level: str = "parent") -> DataFrame:
    """(key, phrase): how the exact forms of a changed key differ between the sides.

    Both sides are reduced to their distinct ladders first.
    """
    changed = diff_libraries(a, b, level).where("status = 'changed'").select(F.col("key").alias(level))
    one = lambda df, n: df.join(changed, level, "left_semi").select(F.col(level).alias("key"), F.struct(*LEVELS).alias(n)).distinct()
    met = one(a, "x").join(one(b, "y"), "key").where("x.exact != y.exact")
    phrase = F.explode(F.split(F.replace(describe_difference("x", "y"), F.lit("; also "), F.lit(";")), ";"))
    return met.select("key", phrase.alias("phrase")).where(~F.col("phrase").isin("identical", "different compounds")).distinct()


def summary(entries: DataFrame) -> DataFrame:
    """Counts of each status, keys with another multiplicity, and Jaccard of the key sets."""
    n = {s: F.count_if(F.col("status") == s) for s in ("added", "removed", "changed", "unchanged")}
    return entries.agg(*(n[s].alias(f"n_{s}") for s in n), F.count_if("multiplicity_changed").alias("multiplicity_changes"), ((n["changed"] + n["unchanged"]) / F.count("*")).alias("jaccard"))
