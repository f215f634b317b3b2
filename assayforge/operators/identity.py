"""Identity ladders: groups, distinct counts, what varies, duplicate issues.

A ladder is a dict from level to key column, strictest first. Rows without a key
at a level take no part in it. Members of a group are rows of a table, never an
array, so a group may be of any size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions.numbering import numbered

LEVELS = ("exact", "parent", "tautomer", "nostereo", "skeleton", "formula")
#: Words for what differs at the strictest level that two records share.
DIFFERENCE = {
    "parent": "salt, counter-ion or charge form",
    "tautomer": "tautomer",
    "nostereo": "stereochemistry",
    "skeleton": "stereochemistry and tautomer",
    "formula": "constitution (same formula only)",
}
DUPLICATE_LEVELS = LEVELS[:5]


def accounting(records: DataFrame, status: str = "status") -> DataFrame:
    """Counts of each status; they add up to the input."""
    return records.groupBy(status).agg(F.count("*").alias("n"))


def distinct_per_level(records: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """One row: rows and distinct keys of each level."""
    return records.agg(F.count("*").alias("n"), *(F.count_distinct(F.col(k)).alias(f"n_{k}") for k in levels))


def groups(records: DataFrame, level: str = "parent", levels: tuple[str, ...] = LEVELS, least: int = 2, split: str | None = None) -> DataFrame:
    """One row per key with at least ``least`` rows: key, size, first position,
    distinct keys of each level, what varies within."""
    aggs = [F.count("*").alias("size"), F.min("position").alias("first_position")]
    aggs += [F.count_distinct(F.col(k)).alias(f"n_{k}") for k in levels if k != level]
    if split:
        aggs.append(F.sort_array(F.collect_set(split)).alias("splits"))
    found = records.where(F.col(level).isNotNull()).groupBy(F.col(level).alias("key")).agg(*aggs).where(F.col("size") >= least)
    return found.withColumn(f"n_{level}", F.lit(1).cast("long")).withColumn("differs_by", differs_by(level))


def differs_by(level: str):
    """What varies in a group, by comparing its numbers of distinct keys."""
    n = {k: F.col(f"n_{k}") for k in LEVELS}
    found = [
        F.when(n["exact"] > n["parent"], "salt, counter-ion or charge form"),
        F.when((n["tautomer"] < n["parent"]) | (n["skeleton"] < n["nostereo"]), "tautomer"),
        F.when((n["nostereo"] < n["parent"]) | (n["skeleton"] < n["tautomer"]), "stereochemistry"),
    ]
    if level == "formula":
        found.append(F.when(n["skeleton"] > 1, "constitution"))
    return F.array_compact(F.array(*found))


def audit_groups(records: DataFrame, level: str = "parent", split: str | None = None) -> DataFrame:
    """All groups, numbered g000000 on, the largest first, then by first position."""
    found = numbered(groups(records, level, least=1, split=split), [F.desc("size"), F.asc("first_position")], "number")
    return found.withColumn("group_id", F.format_string("g%06d", "number")).drop("number")


def members(records: DataFrame, grouped: DataFrame, level: str = "parent") -> DataFrame:
    """(group_id, record_id, position) of every row of a group."""
    return records.join(grouped.select(F.col("key").alias(level), "group_id"), level).select("group_id", "record_id", "position")


def first_of(records: DataFrame, level: str) -> DataFrame:
    """(key, first record) of a level; partial aggregation keeps hot keys cheap."""
    return records.where(F.col(level).isNotNull()).groupBy(F.col(level)).agg(F.min_by("record_id", "position").alias(f"first_{level}"))


def duplicate_issues(records: DataFrame, levels: tuple[str, ...] = DUPLICATE_LEVELS) -> DataFrame:
    """(record_id, code, first_record_id): every record after the first of its key, at each
    level, unless a stricter level already named the same first record."""
    wide = records.select("record_id", *levels)
    for k in levels:
        wide = wide.join(first_of(records, k), k, "left")
    rows, stricter = [], []
    for k in levels:
        first = F.col(f"first_{k}")
        named = F.lit(False)
        for s in stricter:
            named = named | F.coalesce((F.col(f"first_{s}") == first) & (F.col(f"first_{s}") != F.col("record_id")), F.lit(False))
        rows.append(F.when((first != F.col("record_id")) & ~named, F.struct(F.lit(f"DUP_{k.upper()}").alias("code"), first.alias("first_record_id"))))
        stricter.append(k)
    return wide.select("record_id", F.explode(F.array_compact(F.array(*rows))).alias("i")).select("record_id", "i.code", "i.first_record_id")


def shared_level(a: str, b: str, levels: tuple[str, ...] = LEVELS):
    """The strictest level at which the structs ``a`` and ``b`` agree; null if none."""
    return F.coalesce(*(F.when(F.col(f"{a}.{k}") == F.col(f"{b}.{k}"), k) for k in levels))


def describe_difference(a: str, b: str, form_differs=None):
    """In words, what sets two records apart."""
    level = shared_level(a, b)
    text = F.when(level.isNull(), "different compounds").when(level == "exact", "identical")
    for k, words in DIFFERENCE.items():
        also = F.lit(words)
        if form_differs is not None and k != "parent":
            also = F.when(form_differs, F.concat(also, F.lit("; also salt, counter-ion or charge form"))).otherwise(also)
        text = text.when(level == k, also)
    return text
