"""Several sources' answers about one query: consensus, merge, agreement, correction, cache.

Answers are rows of (query, source, priority, ...); priority orders sources, the
smallest first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayforge.functions import text


def consensus(answers: DataFrame, key: str, name_matches: Column | None = None, fragments: str | None = None, neutral: Column | None = None) -> DataFrame:
    """(query, key, n_sources): the key that most sources give; on ties one whose name
    matches the query, then fewest fragments, then neutral, then source order."""
    rows = answers.where(F.col(key).isNotNull())
    best = F.struct(
        (-F.count_distinct("source")).alias("n"),
        F.min(F.when(name_matches, 0).otherwise(1) if name_matches is not None else F.lit(0)).alias("m"),
        F.min(F.coalesce(F.col(fragments), F.lit(2**31 - 1)) if fragments else F.lit(0)).alias("f"),
        F.min(F.when(neutral, 0).otherwise(1) if neutral is not None else F.lit(0)).alias("c"),
        F.min("priority").alias("p"),
    )
    votes = rows.groupBy("query", key).agg(best.alias("order"))
    return votes.groupBy("query").agg(F.min(F.struct("order", F.col(key).alias("k"))).alias("b")).select("query", F.col("b.k").alias(key), (-F.col("b.order.n")).alias("n_sources"))


def merged(answers: DataFrame, columns: list[str]) -> DataFrame:
    """Per query the first non-empty value of each column by source order, and which source it is from."""
    aggs = []
    for c in columns:
        full = F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""
        first = F.min(F.when(full, F.struct("priority", F.col(c).alias("v"), "source")))
        aggs += [first.alias(f"_{c}")]
    found = answers.groupBy("query").agg(*aggs)
    return found.select("query", *(x for c in columns for x in (F.col(f"_{c}.v").alias(c), F.col(f"_{c}.source").alias(f"{c}_source"))))


def synonyms(answers: DataFrame, column: str, most: int = 40) -> DataFrame:
    """(query, synonym, rank): distinct synonyms by source order, at most ``most`` a query (a report)."""
    one = answers.select("query", "priority", F.posexplode(column).alias("at", "synonym")).groupBy("query", "synonym").agg(F.min(F.struct("priority", "at")).alias("o"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("o.priority", "o.at", "synonym")))
    return ranked.where(F.col("rank") <= most).select("query", "synonym", "rank")


def agreement(answers: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(query, n_sources, level): the strictest level at which all answers have the same key."""
    checks = [F.when((F.count_distinct(F.col(k)) == 1) & (F.count(F.col(k)) == F.count("*")), k) for k in levels]
    return answers.groupBy("query").agg(F.count_distinct("source").alias("n_sources"), F.coalesce(*checks).alias("level"))


def differences(answers: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """(query, source_a, source_b, level) of each two sources of a query; sources are few."""
    pick = lambda n: answers.select("query", F.col("source").alias(f"source_{n}"), F.col("priority").alias(f"p_{n}"), F.struct(*levels).alias(n))
    met = pick("a").join(pick("b"), "query").where("p_a < p_b")
    return met.select("query", "source_a", "source_b", F.coalesce(*(F.when(F.col(f"a.{k}") == F.col(f"b.{k}"), k) for k in levels)).alias("level"))


def corrections(answers: DataFrame, agreed: DataFrame, key: str, supplied: DataFrame, sources: DataFrame) -> DataFrame:
    """Answers looked up again by the consensus key, for sources that gave none or another.

    supplied: (source, key, ...) tables at hand; sources: (source, priority).
    Returns (query, source, kind, found): kind missing or outlier.
    """
    wanted = agreed.select("query", key).join(F.broadcast(sources.select("source")))
    given = answers.groupBy("query", "source").agg(F.min(key).alias("_own"))
    state = wanted.join(given, ["query", "source"], "left")
    need = state.where(F.col("_own").isNull() | (F.col("_own") != F.col(key))).withColumn("kind", F.when(F.col("_own").isNull(), "missing").otherwise("outlier"))
    have = supplied.select("source", key).distinct().withColumn("_hit", F.lit(True))
    return need.join(have, ["source", key], "left").select("query", "source", "kind", F.coalesce("_hit", F.lit(False)).alias("found"))


def concordance(answers: DataFrame, queries: DataFrame, n_sources: int, levels: tuple[str, ...]) -> DataFrame:
    """(outcome, n): queries by how their sources agree: not found, one source, a level, or none."""
    seen = queries.select("query").distinct().join(agreement(answers, levels), "query", "left")
    n = F.coalesce("n_sources", F.lit(0))
    outcome = F.when(n == 0, "not found").when(n == 1, "one source").otherwise(F.coalesce("level", F.lit("none")))
    return seen.select(outcome.alias("outcome"), (n == n_sources).alias("complete")).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("complete").alias("n_complete"))


def distinct_queries(queries: DataFrame) -> DataFrame:
    """Queries without repeats, each at its first place."""
    return queries.groupBy(text.cache_key(F.col("query")).alias("query_key")).agg(F.min_by("query", "position").alias("query"), F.min("position").alias("position"))


def lookup(queries: DataFrame, cache: DataFrame, table: DataFrame) -> DataFrame:
    """Queries answered from the cache first, then from the table: (query_key, value, origin)."""
    one = distinct_queries(queries)
    wide = one.join(cache.select("query_key", F.col("value").alias("_c")), "query_key", "left").join(table.select("query_key", F.col("value").alias("_t")), "query_key", "left")
    return wide.select("query_key", "position", F.coalesce("_c", "_t").alias("value"), F.when(F.col("_c").isNotNull(), "cache").when(F.col("_t").isNotNull(), "table").alias("origin"))


def upserted(cache: DataFrame, fresh: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The cache with fresh rows in place of older ones of the same key."""
    both = cache.unionByName(fresh)
    values = [c for c in both.columns if c not in keys]
    last = F.max(F.struct(order, *(c for c in values if c != order)))
    return both.groupBy(*keys).agg(last.alias("_l")).select(*keys, *(F.col(f"_l.{c}").alias(c) for c in values))


def cache_stats(cache: DataFrame) -> DataFrame:
    return cache.groupBy("source").agg(F.count("*").alias("n"))


def routed(queries: DataFrame, valid_structure: Column | None = None) -> DataFrame:
    """Queries with the kind of lookup that answers them."""
    q = text.strip(F.col("query"))
    kind = F.when(q.rlike(r"^\d+$"), "id").when(q.rlike("^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), "inchikey")
    if valid_structure is not None:
        kind = kind.when(valid_structure, "structure")
    return queries.withColumn("route", kind.otherwise("name"))


def cross_references(answers: DataFrame, refs: str) -> DataFrame:
    """(query, database, id): union of the answers' maps, the first source to name a database wins."""
    rows = answers.select("query", "priority", F.explode(refs).alias("database", "id"))
    return rows.groupBy("query", "database").agg(F.min_by("id", F.struct("priority", "id")).alias("id"))
