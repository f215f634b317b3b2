"""Activity cliffs: compound values, pairs, verdicts, transformations, outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions import measure


def compound_values(records: DataFrame, keys: list[str], lo: str, hi: str, threshold: float) -> DataFrame:
    """Each compound's interval: the median of its points if they lie within the
    threshold, else a conflict; without points the intersection of its bounds,
    an empty one being a conflict. Columns lo, hi, n_exact, n_censored, conflict."""
    point = F.col(lo).isNotNull() & (F.col(lo) == F.col(hi))
    found = records.where(F.col(lo).isNotNull() | F.col(hi).isNotNull()).groupBy(*keys).agg(
        F.count_if(point).alias("n_exact"), F.count_if(~F.coalesce(point, F.lit(False))).alias("n_censored"),
        F.percentile(F.when(point, F.col(lo)), 0.5).alias("_middle"), (F.max(F.when(point, F.col(lo))) - F.min(F.when(point, F.col(lo)))).alias("_spread"),
        F.max(lo).alias("_lo"), F.min(hi).alias("_hi"),
    )
    some = F.col("n_exact") > 0
    conflict = F.when(some, F.col("_spread") > threshold).otherwise(F.coalesce(F.col("_lo") > F.col("_hi"), F.lit(False)))
    fine = ~F.col("conflict")
    return found.withColumn("conflict", conflict).select(
        *keys, F.when(fine, F.when(some, F.col("_middle")).otherwise(F.col("_lo"))).alias("lo"), F.when(fine, F.when(some, F.col("_middle")).otherwise(F.col("_hi"))).alias("hi"),
        "n_exact", "n_censored", "conflict",
    )


#: Compounds of one block of ``core_pairs``, about.
BLOCK = 1024


def core_pairs(fragments: DataFrame, context: list[str] | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs of compounds that share a core and differ in the rest.

    fragments: context..., id, core, core_size, rest, rest_size. Of each pair the
    smallest change wins, then the largest core, then text order.

    Compounds with the same fragments pair alike, so they are packed into blocks, and
    the change is decided once for two blocks, in both directions. Only then are the
    members paired, in as many tasks as blocks met, however hot a core or a compound is.
    """
    context = context or []
    known = fragments.where("id is not null and core is not null and rest is not null")
    whole = known.groupBy(*context, "id").agg(F.sort_array(F.collect_set(F.struct("core", "core_size", "rest", "rest_size"))).alias("f"))
    whole = whole.withColumn("kind", F.sha2(F.to_json("f"), 256))
    sizes = whole.groupBy(*context, "kind").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / block))
    blocks = whole.join(sizes, [*context, "kind"]).groupBy(*context, F.concat_ws("-", "kind", part).alias("block")).agg(F.any_value("f").alias("f"), F.collect_list("id").alias("ids"))
    blocks = blocks.select(*context, "block", "ids", F.inline("f"))
    keys = [*context, "core"]
    a = blocks.select(*keys, F.col("block").alias("ba"), F.col("ids").alias("ia"), F.col("core_size").alias("ca"), F.col("rest").alias("ra"), F.col("rest_size").alias("na"))
    b = blocks.select(*keys, F.col("block").alias("bb"), F.col("ids").alias("ib"), F.col("core_size").alias("cb"), F.col("rest").alias("rb"), F.col("rest_size").alias("nb"))
    n = (F.col("na") + F.col("nb")).alias("n")
    order = F.struct(n, (-F.col("ca")).alias("c"), F.col("ra").alias("from"), F.col("rb").alias("to"), "core")
    turned = F.struct(n, (-F.col("cb")).alias("c"), F.col("rb").alias("from"), F.col("ra").alias("to"), "core")
    # A number of its own keeps the tasks apart that a few bytes here make many pairs in.
    met = a.join(b, keys).where("ba <= bb and ra != rb").repartition(int(fragments.sparkSession.conf.get("spark.sql.shuffle.partitions")), *context, "ba", "bb")
    best = met.groupBy(*context, "ba", "bb").agg(F.min(order).alias("o"), F.min(turned).alias("t"), F.any_value("ia").alias("ia"), F.any_value("ib").alias("ib"))
    change = lambda o: F.struct(F.col(f"{o}.core").alias("core"), F.concat_ws(">>", f"{o}.from", f"{o}.to").alias("transformation"))
    best = best.select(*context, (F.col("ba") == F.col("bb")).alias("same"), "ia", "ib", change("o").alias("o"), change("t").alias("t"), F.col("o.n").cast("long").alias("n_changed"))
    pairs = best.withColumn("x", F.explode("ia")).withColumn("y", F.explode("ib")).where("not same or x < y")
    pick = lambda name: F.when(F.col("x") < F.col("y"), F.col(f"o.{name}")).otherwise(F.col(f"t.{name}")).alias(name)
    return pairs.select(*context, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), pick("core"), pick("transformation"), "n_changed")


def similar_pairs(items: DataFrame, threshold: float, n_bits: int = 64) -> DataFrame:
    """Pairs (a, b, similarity) of 64-bit words (id, fp) with Tanimoto at the threshold or above.

    Prefix filter: of a word with n bits any partner shares one of its first
    n - ceil(t n) + 1 bits in a global order, the rarest first, so pairs meet by an
    equi-join on those. A pair is made only at its first common one, so none is
    made twice and none is lost.
    """
    from assayforge.functions.similarity import tanimoto_word, word_bits

    bits = items.select("id", "fp", F.explode(word_bits(F.col("fp"))).alias("bit"))
    order = [r["bit"] for r in bits.groupBy("bit").count().orderBy("count", "bit").collect()]  # at most n_bits numbers
    rank = {bit: i for i, bit in enumerate(order)}
    place = F.create_map(*[F.lit(x) for kv in (rank or {0: 0}).items() for x in kv])
    ranks = F.array_sort(F.transform(word_bits(F.col("fp")), lambda b: F.element_at(place, b)))
    n = F.bit_count("fp")
    prefix = F.slice(F.col("ranks"), 1, (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int"))
    # The prefix also as a mask over ranks, so that "first common one" is a test of bits.
    mask = F.aggregate("prefix", F.lit(0).cast("long"), lambda m, r: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), r)))
    sized = items.where("fp != 0").select("id", "fp", ranks.alias("ranks"))
    keyed = sized.select("id", "fp", prefix.alias("prefix")).withColumn("mask", mask).select("id", "fp", "mask", F.explode("prefix").alias("key"))
    a = keyed.select("key", F.col("id").alias("a"), F.col("fp").alias("fa"), F.col("mask").alias("ma"))
    b = keyed.select("key", F.col("id").alias("b"), F.col("fp").alias("fb"), F.col("mask").alias("mb"))
    met = a.join(b, "key").where("a < b and (ma & mb & (shiftleft(1L, key) - 1L)) = 0")
    return met.withColumn("similarity", tanimoto_word(F.col("fa"), F.col("fb"))).where(F.col("similarity") >= threshold).select("a", "b", "similarity")


def merge_pairs(by_core: DataFrame, by_similarity: DataFrame) -> DataFrame:
    """Both kinds of pairs in one table, with how each is related."""
    both = by_core.join(by_similarity, ["a", "b"], "full_outer")
    kind = F.when(F.col("core").isNull(), "similarity").when(F.col("similarity").isNull(), "mmp").otherwise("mmp+similarity")
    return both.withColumn("relationship", kind)


def verdicts(pairs: DataFrame, values: DataFrame, threshold: float, kind: str = "quantitative") -> DataFrame:
    """Pairs with least, most, signed difference and verdict; values: id, lo, hi (or label)."""
    if kind == "classification":
        wide = pairs.join(values.select(F.col("id").alias("a"), F.col("label").alias("la")), "a").join(values.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b")
        return wide.withColumn("verdict", F.when(F.col("la") != F.col("lb"), "cliff").otherwise("consistent"))
    wide = pairs.join(values.select(F.col("id").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi")), "a")
    wide = wide.join(values.select(F.col("id").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi")), "b")
    g = measure.gap(F.col("alo"), F.col("ahi"), F.col("blo"), F.col("bhi"))
    signed = F.when((F.col("alo") == F.col("ahi")) & (F.col("blo") == F.col("bhi")), F.col("blo") - F.col("alo"))
    wide = wide.withColumn("_g", g)
    return wide.select("*", F.col("_g.least").alias("least"), F.col("_g.most").alias("most"), signed.alias("signed"), measure.verdict(F.col("_g"), threshold).alias("verdict")).drop("_g")


def transformations(judged: DataFrame, name: str = "transformation") -> DataFrame:
    """Per transformation, in its canonical direction: pairs, verdicts, mean signed difference."""
    t = F.split(F.col(name), ">>")
    turned = t[0] > t[1]
    rows = judged.where(F.col(name).isNotNull()).select(
        F.when(turned, F.concat_ws(">>", t[1], t[0])).otherwise(F.col(name)).alias(name), F.when(turned, -F.col("signed")).otherwise(F.col("signed")).alias("signed"), "verdict"
    )
    return rows.groupBy(name).agg(
        F.count("*").alias("n_pairs"), *(F.count_if(F.col("verdict") == v).alias(f"n_{v}") for v in ("cliff", "consistent", "undetermined")),
        F.count("signed").alias("n_exact_pairs"), F.avg("signed").alias("mean_signed"),
    )


def suspects(judged: DataFrame, least: int = 2) -> DataFrame:
    """Compounds all of whose neighbours are cliffs: (id, n_neighbours)."""
    ends = judged.select(F.col("a").alias("id"), "verdict").unionByName(judged.select(F.col("b").alias("id"), "verdict"))
    return ends.groupBy("id").agg(F.count("*").alias("n_neighbours"), F.bool_and(F.col("verdict") == "cliff").alias("all_cliffs")).where(F.col("all_cliffs") & (F.col("n_neighbours") >= least)).select("id", "n_neighbours")


def outliers(judged: DataFrame, values: DataFrame, threshold: float, least: int = 2) -> DataFrame:
    """Suspects whose neighbours agree with one another: (id, n_neighbours, n_agreeing).

    Intervals are pairwise consistent if their hull is narrower than the
    threshold, so the largest such set is anchored at one member's lower end and
    needs no search over subsets. Neighbours with an open end agree with none.
    """
    few = suspects(judged, least)
    ends = judged.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(judged.select(F.col("b").alias("id"), F.col("a").alias("other")))
    near = ends.join(few.select("id"), "id").join(values.select(F.col("id").alias("other"), "lo", "hi"), "other").where("lo is not null and hi is not null")
    anchor = near.select("id", F.col("other").alias("x"), F.col("lo").alias("from"))
    met = anchor.join(near, "id").where((F.col("lo") > F.col("from")) | ((F.col("lo") == F.col("from")) & (F.col("other") >= F.col("x"))))
    agree = met.where(F.col("hi") - F.col("from") < threshold).groupBy("id", "x").agg(F.count("*").alias("n")).groupBy("id").agg(F.max("n").alias("n_agreeing"))
    return few.join(agree, "id").where(F.col("n_agreeing") >= least)


def summary(judged: DataFrame) -> DataFrame:
    """Counts of verdicts and the share of cliffs among decided pairs."""
    c = {v: F.count_if(F.col("verdict") == v) for v in ("cliff", "consistent", "undetermined")}
    decided = c["cliff"] + c["consistent"]
    return judged.agg(F.count("*").alias("n_pairs"), *(c[v].alias(f"n_{v}") for v in c), F.when(decided > 0, c["cliff"] / decided).alias("cliff_fraction"))
