"""Splits that keep groups whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.functions.numbering import checkpointed


def group_key(strategy: str, record_id: str = "record_id", **columns: str) -> Column:
    """The key that a strategy keeps together; null excludes a record.

    random: each its own; temporal, source: that field; scaffold: the scaffold, or
    the record where it is acyclic or unreadable; identity: the identity key.
    """
    if strategy == "random":
        return F.col(record_id).cast("string")
    if strategy == "scaffold":
        s = F.col(columns["scaffold"])
        own = F.when(s == "acyclic", F.concat(F.lit("acyclic:"), F.col(record_id).cast("string"))).otherwise(s)
        own = F.coalesce(own, F.concat(F.lit("invalid:"), F.col(record_id).cast("string")))
        return F.when(F.coalesce(F.trim(F.col(columns["structure"])), F.lit("")) != "", own) if "structure" in columns else own
    return F.nullif(F.trim(F.col(columns[strategy]).cast("string")), F.lit(""))


def ordered_fill(records: DataFrame, key: str, fractions: dict[str, float]) -> DataFrame:
    """(key, n, split): keys in ascending order fill the splits up to their targets.

    Key counts are summed over runs of keys first (one number a run meets in one
    place), then within each run.
    """
    groups = records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    sorted_ = checkpointed(groups.orderBy(key).withColumn("_run", F.spark_partition_id()))
    before = sorted_.groupBy("_run").agg(F.sum("n").alias("_n"))
    before = before.select("_run", (F.sum("_n").over(Window.orderBy("_run")) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    inside = sorted_.withColumn("_in", F.sum("n").over(Window.partitionBy("_run").orderBy(key)) - F.col("n"))
    placed = inside.join(F.broadcast(before), "_run").withColumn("_at", F.col("_before") + F.col("_in"))
    return _fill(placed.select(key, "n", "_at", "_total"), key, list(fractions), fractions)


def _fill(state: DataFrame, key: str, names: list[str], fractions: dict[str, float]) -> DataFrame:
    """Split of each key from the records before it.

    The first split takes keys while fewer records than its target come before;
    the next one starts at the first key that it did not take, and so on: one
    small aggregate per split finds where.
    """
    out = F.lit(names[-1])
    total = F.col("_total")
    rows = state
    for i in range(len(names) - 1):
        begin = f"_start{i}"
        if i == 0:
            rows = rows.withColumn(begin, F.lit(0).cast("long"))
        else:
            prior = f"_start{i - 1}"
            edge = rows.where(F.col("_at") - F.col(prior) >= F.col("_total") * F.lit(fractions[names[i - 1]])).agg(F.min("_at").alias(begin))
            rows = rows.join(F.broadcast(edge)).withColumn(begin, F.coalesce(begin, F.col("_total")))
    for i in reversed(range(len(names) - 1)):
        begin = F.col(f"_start{i}")
        out = F.when((F.col("_at") >= begin) & (F.col("_at") - begin < total * F.lit(fractions[names[i]])), names[i]).otherwise(out)
    return rows.select(key, "n", out.alias("split"))


def greedy_fill(records: DataFrame, key: str, fractions: dict[str, float], seed: int = 0) -> DataFrame:
    """(key, n, split): largest groups first, each to the split furthest below its target.

    Equal groups are interchangeable, so the driver decides how many of each size
    go where (one number a size), and a seeded order within the size decides which.
    """
    groups = checkpointed(records.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    classes = [(r["n"], r["c"]) for r in groups.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect()]
    total = sum(n * c for n, c in classes)
    target = {s: f * total for s, f in fractions.items()}
    have = dict.fromkeys(fractions, 0)
    rows = []
    for n, c in classes:
        first = 0
        for split, times in _deal(n, c, have, target):
            rows.append((n, first, first + times, split))
            first += times
    spark = records.sparkSession
    plan = spark.createDataFrame(rows or [], "n long, lo long, hi long, split string")
    shuffled = F.row_number().over(Window.partitionBy("n", "_b").orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)) - 1
    buckets = 64
    placed = groups.withColumn("_b", F.pmod(F.xxhash64(F.col(key), F.lit(seed + 1)), F.lit(buckets))).withColumn("_r", shuffled)
    counts = placed.groupBy("n", "_b").agg(F.count("*").alias("_c"))
    before = counts.select("n", "_b", (F.sum("_c").over(Window.partitionBy("n").orderBy("_b")) - F.col("_c")).alias("_before"))
    ranked = placed.join(before, ["n", "_b"]).withColumn("_rank", F.col("_r") + F.col("_before"))
    p = plan.withColumnRenamed("n", "_pn")
    return ranked.join(F.broadcast(p), (F.col("n") == F.col("_pn")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi"))).select(key, "n", "split")


def _deal(n: int, count: int, have: dict[str, int], target: dict[str, float]) -> list[tuple[str, int]]:
    """How many of ``count`` groups of size n go to which split, in runs.

    The rule takes the split with the lowest relative surplus each time; after the
    splits have drawn level it alternates; runs to one split are dealt at once.
    """
    names = list(have)
    surplus = lambda s: (have[s] - target[s]) / max(target[s], 1e-9)
    given = dict.fromkeys(names, 0)
    left = count
    while left:
        s = min(names, key=surplus)
        rest = [surplus(x) for x in names if x != s]
        if not rest:
            step = left
        else:
            room = (min(rest) - surplus(s)) * max(target[s], 1e-9) / n
            step = max(1, min(left, int(room)))
        have[s] += n * step
        given[s] += step
        left -= step
    return [(s, given[s]) for s in names if given[s]]


def assign(records: DataFrame, key: str, plan: DataFrame) -> DataFrame:
    """Every record with its group's split; records without a key are left out."""
    return records.join(plan.select(key, "split"), key)


def balance(assigned: DataFrame, endpoint: str) -> DataFrame:
    """Per split, of the endpoint: how many, mean, least and most where it is a number."""
    v = F.col(endpoint).cast("string").try_cast("double")
    return assigned.where(v.isNotNull()).groupBy("split").agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.min(v).alias("least"), F.max(v).alias("most"))


def label_balance(assigned: DataFrame, endpoint: str) -> DataFrame:
    """Per split and label: its share."""
    counts = assigned.where(F.col(endpoint).isNotNull()).groupBy("split", F.col(endpoint).alias("label")).agg(F.count("*").alias("n"))
    return counts.select("split", "label", "n", (F.col("n") / F.sum("n").over(Window.partitionBy("split"))).alias("share"))


def group_sizes(plan: DataFrame) -> DataFrame:
    """Least, upper median and largest size of groups, and the largest one's share."""
    sizes = plan.groupBy("n").agg(F.count("*").alias("c"))
    total = sizes.agg(F.sum("c").alias("groups"), F.sum(F.col("n") * F.col("c")).alias("records"), F.min("n").alias("least"), F.max("n").alias("most"))
    run = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("n")))  # one row a size
    middle = run.join(F.broadcast(total.select("groups"))).where(F.col("upto") > F.floor(F.col("groups") / 2)).agg(F.min("n").alias("middle"))
    return total.join(middle).select("groups", "records", "least", "middle", "most", (F.col("most") / F.col("records")).alias("largest_share"))
