"""Leakage between splits: shared keys, relatives, order in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.operators.identity import LEVELS, first_of

OVERLAP_LEVELS = LEVELS[:5]


def overlap_rows(reference: DataFrame, evaluation: DataFrame, level: str) -> DataFrame:
    """Each evaluation record whose key the reference has, with the first reference record."""
    first = first_of(reference, level).withColumnRenamed(f"first_{level}", "reference_record_id")
    hits = evaluation.select("record_id", "position", level).join(first, level)
    return hits.select(F.lit(level).alias("level"), "record_id", "position", F.col(level).alias("key"), "reference_record_id")


def overlap(reference: DataFrame, evaluation: DataFrame, levels: tuple[str, ...] = OVERLAP_LEVELS) -> DataFrame:
    """One row a level: shared evaluation records and keys, and the evaluation's size."""
    n = evaluation.agg(F.count("*").alias("n_evaluation"))
    out = None
    for k in levels:
        rows = overlap_rows(reference, evaluation, k)
        one = rows.agg(F.count("*").alias("n_eval_records"), F.count_distinct("key").alias("n_eval_groups")).withColumn("level", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(n)).select("level", "n_eval_records", "n_eval_groups", "n_evaluation")


def formula_matches(reference: DataFrame, evaluation: DataFrame, key: str = "formula") -> DataFrame:
    """How many evaluation records share a formula with the reference."""
    return evaluation.join(reference.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("formula_matches"))


def scaffold_overlap(reference: DataFrame, evaluation: DataFrame, key: str = "scaffold", acyclic: str = "acyclic") -> DataFrame:
    """Shared scaffolds among cyclic records: (n_cyclic, n_shared)."""
    cyclic = evaluation.where(F.col(key) != acyclic)
    known = reference.where(F.col(key) != acyclic).select(key).distinct().withColumn("shared", F.lit(1))
    return cyclic.join(known, key, "left").agg(F.count("*").alias("n_cyclic"), F.count("shared").alias("n_shared"))


def blocks(df: DataFrame, key: str, n: int) -> DataFrame:
    """Rows dealt into n blocks."""
    return df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(n)))


def against_blocks(queries: DataFrame, n: int) -> DataFrame:
    """Every query once for each block, so that it meets all rows by an equi-join on blocks."""
    return queries.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))


def nearest(reference: DataFrame, evaluation: DataFrame, similarity: Column, n_blocks: int = 16) -> DataFrame:
    """Each evaluation record's most similar reference record, the first on ties.

    evaluation has (record_id, fp); reference (ref_id, ref_position, ref_fp).
    The best of each block is aggregated before anything is shuffled again.
    """
    met = against_blocks(evaluation.select("record_id", "fp"), n_blocks).join(blocks(reference.select("ref_id", "ref_position", "ref_fp"), "ref_id", n_blocks), "_block")
    scored = met.select("record_id", "ref_id", F.struct(similarity.alias("s"), (-F.col("ref_position")).alias("p")).alias("rank"))
    return scored.groupBy("record_id").agg(F.max_by("ref_id", "rank").alias("reference_record_id"), F.max("rank").alias("rank")).select("record_id", "reference_record_id", F.col("rank.s").alias("similarity"))


def related(neighbours: DataFrame, overlapping: DataFrame, threshold: float) -> DataFrame:
    """Neighbours at or above the threshold that no identity level has already named."""
    return neighbours.where(F.col("similarity") >= threshold).join(overlapping.select("record_id").distinct(), "record_id", "left_anti")


def temporal_violations(reference: DataFrame, evaluation: DataFrame, date: str = "date") -> DataFrame:
    """Evaluation records dated no later than the latest reference date (text order)."""
    latest = reference.where(F.coalesce(F.col(date), F.lit("")) != "").agg(F.max(date).alias("latest_reference_date"))
    return evaluation.where(F.coalesce(F.col(date), F.lit("")) != "").join(F.broadcast(latest), F.col(date) <= F.col("latest_reference_date"))


def within_split_duplicates(records: DataFrame, split: str, key: str) -> DataFrame:
    """Rows beyond the distinct keys of each split."""
    return records.where(F.col(key).isNotNull()).groupBy(split).agg((F.count("*") - F.count_distinct(key)).alias("n_duplicates"))


def reference_split(records: DataFrame, split: str) -> str | None:
    """The largest split, the first met on ties."""
    top = records.where(F.col(split).isNotNull()).groupBy(split).agg(F.count("*").alias("n"), F.min("position").alias("p")).orderBy(F.desc("n"), "p").limit(1).collect()
    return top[0][split] if top else None


def report(records: DataFrame, split: str = "split", reference: str | None = None) -> DataFrame:
    """overlap() of the reference split with every other, and of the others pairwise."""
    names = [r[split] for r in records.where(F.col(split).isNotNull()).groupBy(split).agg(F.min("position").alias("p")).orderBy("p").collect()]
    first = reference or reference_split(records, split)
    others = [n for n in names if n != first]
    pairs = [(first, n) for n in others] + [(a, b) for i, a in enumerate(others) for b in others[i + 1 :]]
    part = {n: records.where(F.col(split) == n) for n in names}
    out = None
    for a, b in pairs:
        one = overlap(part[a], part[b]).select(F.lit(a).alias("reference_split"), F.lit(b).alias("evaluation_split"), "*")
        out = one if out is None else out.unionByName(one)
    return out if out is not None else records.sparkSession.createDataFrame([], "reference_split string, evaluation_split string, level string, n_eval_records long, n_eval_groups long, n_evaluation long")
