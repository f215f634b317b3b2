"""Pattern catalogues: hits, breadth, dead patterns, duplicates, equivalence,
subsumption, sensitivity to preparation, differences and clean-up.

A catalogue has pattern_id (its order), name and pattern. Hits are the sparse
table (pattern_id, item_id, preparation); an item that a preparation could not
be made of is missing from ``evaluated``, which is not the same as no hit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions.numbering import checkpointed


def hits(items: DataFrame, patterns: list[tuple[int, str]], preparations: dict[str, Column], match: Callable[[Column, str], Column] | None = None) -> DataFrame:
    """Hits of (pattern_id, pattern) on items (item_id, ...).

    The catalogue is part of the plan, so each item is read once and no pairs are
    made but hits: each preparation yields the array of patterns that match.
    """
    match = match or (lambda c, p: c.rlike(p))
    made = []
    for name, prepared in preparations.items():
        for pattern_id, pattern in patterns:
            made.append(F.when(F.coalesce(match(prepared, pattern), F.lit(False)), F.struct(F.lit(pattern_id).alias("pattern_id"), F.lit(name).alias("preparation"))))
    return items.select("item_id", F.explode(F.array_compact(F.array(*made))).alias("h")).select("h.pattern_id", "item_id", "h.preparation")


def breadth(found: DataFrame, evaluated: DataFrame, threshold: float = 0.10) -> DataFrame:
    """Per pattern and preparation: hits, items evaluated, whether the share is over the threshold.

    Patterns without hits are in dead().
    """
    n = evaluated.groupBy("preparation").agg(F.count("*").alias("n_evaluated"))
    counts = found.groupBy("pattern_id", "preparation").agg(F.count("*").alias("n_hits"))
    return counts.join(F.broadcast(n), "preparation").withColumn("broad", F.col("n_hits") / F.col("n_evaluated") > threshold)


def dead(catalogue: DataFrame, found: DataFrame, preparation: str) -> DataFrame:
    """Patterns without a hit in a preparation, and whether another one revives them."""
    here = found.where(F.col("preparation") == preparation).select("pattern_id").distinct()
    there = found.where(F.col("preparation") != preparation).select("pattern_id").distinct().withColumn("_alive", F.lit(True))
    gone = catalogue.select("pattern_id").join(here, "pattern_id", "left_anti")
    return gone.join(there, "pattern_id", "left").select("pattern_id", F.coalesce("_alive", F.lit(False)).alias("alive_elsewhere"))


def exact_duplicates(catalogue: DataFrame) -> DataFrame:
    """(pattern_id, duplicate_of): the same text as an earlier pattern."""
    first = catalogue.groupBy("pattern").agg(F.min("pattern_id").alias("duplicate_of"))
    return catalogue.join(first, "pattern").where("pattern_id != duplicate_of").select("pattern_id", "duplicate_of")


def _overlaps(found: DataFrame) -> DataFrame:
    """(a, b, common, na, nb) of patterns that share an item: pairs are aggregated
    item by item, map-side, so the result has at most one row a pair."""
    own = found.select("pattern_id", "item_id").distinct()
    size = own.groupBy("pattern_id").agg(F.count("*").alias("n"))
    lists = own.groupBy("item_id").agg(F.collect_set("pattern_id").alias("p"))  # at most the catalogue
    a = F.explode("p").alias("a")
    pair = lists.select("p", a).select("a", F.explode("p").alias("b")).where("a != b").groupBy("a", "b").agg(F.count("*").alias("common"))
    return pair.join(size.select(F.col("pattern_id").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("pattern_id").alias("b"), F.col("n").alias("nb")), "b")


def equivalent(found: DataFrame) -> DataFrame:
    """(pattern_id, equivalent_to): the earliest other pattern with the same non-empty hits."""
    same = _overlaps(found).where("common = na and common = nb")
    return same.groupBy(F.col("a").alias("pattern_id")).agg(F.min("b").alias("equivalent_to"))


def subsumed(found: DataFrame) -> DataFrame:
    """(pattern_id, subsumed_by): the smallest strict superset of its hits, the earliest on ties."""
    inside = _overlaps(found).where("common = na and na < nb")
    return inside.groupBy(F.col("a").alias("pattern_id")).agg(F.min(F.struct("nb", "b")).alias("s")).select("pattern_id", F.col("s.b").alias("subsumed_by"))


def sensitivity(found: DataFrame, evaluated: DataFrame, base: str) -> DataFrame:
    """Per preparation: flagged items, hits, patterns that fire, and items whose verdict
    differs from the base among those evaluated in both."""
    flagged = found.select("item_id", "preparation").distinct().withColumn("_flag", F.lit(1))
    state = evaluated.select("item_id", "preparation").join(flagged, ["item_id", "preparation"], "left").select("item_id", "preparation", F.col("_flag").isNotNull().alias("flag"))
    mine = state.where(F.col("preparation") == base).select("item_id", F.col("flag").alias("_base"))
    flips = state.join(mine, "item_id", "left").groupBy("preparation").agg(F.count_if("flag").alias("n_flagged"), F.count_if(F.col("flag") != F.col("_base")).alias("n_flips"))
    fires = found.groupBy("preparation").agg(F.count("*").alias("n_hits"), F.count_distinct("pattern_id").alias("n_firing"))
    return flips.join(fires, "preparation", "left").select("preparation", "n_flagged", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), F.coalesce("n_firing", F.lit(0)).alias("n_firing"), "n_flips")


def examples(found: DataFrame, n: int = 3) -> DataFrame:
    """The first n items of each pattern and preparation, by id: a bounded report."""
    top = F.expr(f"slice(array_sort(collect_list(item_id)), 1, {n})")
    # Smallest ids are kept step by step, so no list ever grows past its bucket's.
    bucket = F.pmod(F.xxhash64("item_id"), F.lit(1024))
    few = found.groupBy("pattern_id", "preparation", bucket.alias("_b")).agg(top.alias("ids")).select("pattern_id", "preparation", F.explode("ids").alias("item_id"))
    return few.groupBy("pattern_id", "preparation").agg(top.alias("examples"))


def revived(dead_here: DataFrame, found_there: DataFrame) -> DataFrame:
    """Patterns that are dead on one panel and fire on another."""
    return dead_here.select("pattern_id").join(found_there.select("pattern_id").distinct(), "pattern_id", "left_semi")


def panel(items: DataFrame, key: str) -> DataFrame:
    """One row: items, distinct ones, and a hash that does not depend on their order."""
    word = F.xxhash64(key)
    return items.agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_distinct"), F.bit_xor(word).alias("fold"), F.sum(F.shiftright(word, 32).cast("decimal(38,0)")).alias("total"))


def evidence(catalogue: DataFrame, found: DataFrame, evaluated: DataFrame, base: str, broad_over: float = 0.10) -> DataFrame:
    """(pattern_id, labels): all that the checks hold against each pattern."""
    one = found.where(F.col("preparation") == base)
    rows = catalogue.select("pattern_id")
    parts = {
        "broad": breadth(one, evaluated, broad_over).where("broad").select("pattern_id"),
        "dead": dead(catalogue, found, base).select("pattern_id"),
        "needs_preparation": dead(catalogue, found, base).where("alive_elsewhere").select("pattern_id"),
        "exact_duplicate": exact_duplicates(catalogue).select("pattern_id"),
        "equivalent": equivalent(one).select("pattern_id"),
        "subsumed": subsumed(one).select("pattern_id"),
    }
    for name, ids in parts.items():
        rows = rows.join(F.broadcast(ids.withColumn(f"_{name}", F.lit(name))), "pattern_id", "left")
    return rows.select("pattern_id", F.array_compact(F.array(*(F.col(f"_{n}") for n in parts))).alias("labels"))


def pair_catalogues(a: DataFrame, b: DataFrame, hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """(a, b, paired_by): patterns paired by name, then by text, then by equal non-empty
    hits; the i-th with the i-th; a or b null where there is no partner. Catalogues are small."""
    from pyspark.sql import Window

    def nth(df: DataFrame, key: str, side: str) -> DataFrame:
        return df.where(F.col(key).isNotNull()).select(F.col(key).alias("_k"), F.row_number().over(Window.partitionBy(key).orderBy("pattern_id")).alias("_n"), F.col("pattern_id").alias(side))

    sign = lambda h: h.select("pattern_id", "item_id").distinct().groupBy("pattern_id").agg(F.concat_ws("/", F.count("*"), F.bit_xor(F.xxhash64("item_id")), F.sum(F.shiftright(F.xxhash64("item_id"), 32))).alias("hit_set"))
    left, right = a.join(sign(hits_a), "pattern_id", "left"), b.join(sign(hits_b), "pattern_id", "left")
    out = None
    for key, how in (("name", "name"), ("pattern", "pattern"), ("hit_set", "hits")):
        # Each pass reads what the one before left over; written, it is worked out once.
        met = checkpointed(nth(left, key, "a").join(nth(right, key, "b"), ["_k", "_n"]).select("a", "b", F.lit(how).alias("paired_by")).coalesce(1))
        out = met if out is None else out.unionByName(met)
        left = checkpointed(left.join(met.select(F.col("a").alias("pattern_id")), "pattern_id", "left_anti").coalesce(1))
        right = checkpointed(right.join(met.select(F.col("b").alias("pattern_id")), "pattern_id", "left_anti").coalesce(1))
    none = F.lit(None).cast("int")
    out = out.unionByName(left.select(F.col("pattern_id").alias("a"), none.alias("b"), F.lit("removed").alias("paired_by")))
    return out.unionByName(right.select(none.alias("a"), F.col("pattern_id").alias("b"), F.lit("added").alias("paired_by")))


def behaviour(pairs: DataFrame, hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """Pairs with hits only of a, only of b and of both, and what changed."""
    one = lambda h, side, flag: h.select(F.col("pattern_id").alias(side), "item_id").distinct().withColumn(flag, F.lit(1))
    ha = pairs.where("a is not null").join(one(hits_a, "a", "_a"), "a").select("a", "b", "item_id", "_a", F.lit(None).cast("int").alias("_b"))
    hb = pairs.where("b is not null").join(one(hits_b, "b", "_b"), "b").select("a", "b", "item_id", F.lit(None).cast("int").alias("_a"), "_b")
    both = ha.unionByName(hb).groupBy("a", "b", "item_id").agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    counts = both.groupBy("a", "b").agg(
        F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common")
    )
    c = pairs.alias("p").join(counts.alias("c"), F.col("p.a").eqNullSafe(F.col("c.a")) & F.col("p.b").eqNullSafe(F.col("c.b")), "left")
    n = {k: F.coalesce(F.col(f"c.{k}"), F.lit(0)) for k in ("only_a", "only_b", "common")}
    kind = (
        F.when(F.col("p.a").isNull(), "added").when(F.col("p.b").isNull(), "removed")
        .when((n["only_a"] == 0) & (n["only_b"] == 0), "same")
        .when((n["common"] == 0) & (n["only_b"] == 0), "broken").when((n["common"] == 0) & (n["only_a"] == 0), "repaired")
        .when(n["only_a"] == 0, "broadened").when(n["only_b"] == 0, "narrowed").otherwise("shifted")
    )
    return c.select(F.col("p.a").alias("a"), F.col("p.b").alias("b"), "p.paired_by", *(n[k].alias(k) for k in n), kind.alias("behaviour"))


def verdict_changes(evaluated: DataFrame, hits_a: DataFrame, hits_b: DataFrame) -> DataFrame:
    """One row: items flagged by each catalogue and by one only."""
    one = lambda h, flag: h.select("item_id").distinct().withColumn(flag, F.lit(1))
    wide = evaluated.select("item_id").distinct().join(one(hits_a, "_a"), "item_id", "left").join(one(hits_b, "_b"), "item_id", "left")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return wide.agg(F.count("*").alias("n_items"), F.count_if(a).alias("n_flagged_a"), F.count_if(b).alias("n_flagged_b"), F.count_if(a & ~b).alias("n_only_a"), F.count_if(b & ~a).alias("n_only_b"))


def cleanup(catalogue: DataFrame, found: DataFrame, proven: DataFrame | None = None) -> DataFrame:
    """(pattern_id, action, because_of): remove exact duplicates and proven equivalents of an
    earlier pattern, review what a panel alone shows, keep the rest.

    proven: (pattern_id, equivalent_to) from proofs; hits alone never recommend removal.
    """
    dup = exact_duplicates(catalogue).select("pattern_id", F.col("duplicate_of").alias("_d"))
    rows = catalogue.select("pattern_id").join(dup, "pattern_id", "left")
    if proven is not None:
        rows = rows.join(proven.where("equivalent_to < pattern_id").groupBy("pattern_id").agg(F.min("equivalent_to").alias("_p")), "pattern_id", "left")
    else:
        rows = rows.withColumn("_p", F.lit(None).cast("int"))
    rows = rows.join(equivalent(found).where("equivalent_to < pattern_id").select("pattern_id", F.col("equivalent_to").alias("_e")), "pattern_id", "left")
    rows = rows.join(subsumed(found).select("pattern_id", F.col("subsumed_by").alias("_s")), "pattern_id", "left")
    remove = F.coalesce("_d", "_p")
    review = F.coalesce("_e", "_s")
    action = F.when(remove.isNotNull(), "remove").when(review.isNotNull(), "review").otherwise("keep")
    return rows.select("pattern_id", action.alias("action"), F.coalesce(remove, review).alias("because_of"))


def lost_by_removal(found: DataFrame, removed: DataFrame) -> DataFrame:
    """Items that only removed patterns flag: the verdicts that a clean-up changes."""
    stays = found.join(removed.select("pattern_id"), "pattern_id", "left_anti").select("item_id").distinct()
    return found.select("item_id").distinct().join(stays, "item_id", "left_anti")
