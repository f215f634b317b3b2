"""Operators bound to the driver's tables, with the same in SQL.

The tables hold no molecules, so columns stand in for what chemistry yields: the
identity ladder is built from ``part``, structures and labels from other tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.functions import measure, rules, similarity
from assayforge.functions.numbering import checkpointed
from assayforge.operators import audit, cliffs, conflicts, diff, generation, identity, leakage, merge, patterns, search, splits

FLAGSHIP = "distinct_per_level"
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LADDER = {
    "exact": ("p_name", "p_brand", "p_type", "p_size"),
    "parent": ("p_name", "p_brand", "p_type"),
    "tautomer": ("p_name", "p_brand"),
    "nostereo": ("p_name", "p_type"),
    "skeleton": ("p_name",),
}
LADDER_SQL = "l AS (SELECT p_partkey AS record_id, p_partkey AS position, p_size, p_brand, p_retailprice, p_type, " + ", ".join(f"concat_ws('|', {', '.join(f'CAST({c} AS VARCHAR)' for c in cs)}) AS {k}" for k, cs in LADDER.items()) + ", CAST(length(p_name) AS VARCHAR) AS formula FROM part)"


def ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    keys = [F.concat_ws("|", *(F.col(c).cast("string") for c in cs)).alias(k) for k, cs in LADDER.items()]
    return part.select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("position"), "p_size", "p_brand", "p_retailprice", "p_type", *keys, F.length("p_name").cast("string").alias("formula"))


def _halves(spark: SparkSession, sf_dir: str, n: int = 10) -> tuple[DataFrame, DataFrame]:
    rows = ladder(spark, sf_dir)
    return rows.where(F.col("record_id") % n != 0), rows.where(F.col("record_id") % n == 0)


HALVES = f"WITH {LADDER_SQL}, ref AS (SELECT * FROM l WHERE record_id % 10 <> 0), ev AS (SELECT * FROM l WHERE record_id % 10 = 0)"


# ---- identity


@query(
    "WITH t AS (SELECT CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS s FROM documents) "
    "SELECT CASE WHEN trim(coalesce(s, '')) = '' OR lower(s) = 'nan' THEN 'empty' ELSE 'ok' END AS status, count(*) AS n FROM t GROUP BY 1"
)
def accounting(spark, sf_dir):
    from assayforge.functions import text

    docs = table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("text")).alias("s"))
    return identity.accounting(docs.select(F.when(text.is_empty_structure(F.col("s")), "empty").otherwise("ok").alias("status")))


@query(f"WITH {LADDER_SQL} SELECT count(*) AS n, " + ", ".join(f"count(DISTINCT {k}) AS n_{k}" for k in identity.LEVELS) + " FROM l")
def distinct_per_level(spark, sf_dir):
    return identity.distinct_per_level(ladder(spark, sf_dir))


@query(
    f"WITH {LADDER_SQL}, g AS (SELECT parent AS key, count(*) AS size, min(position) AS first_position, count(DISTINCT exact) AS n_exact, count(DISTINCT tautomer) AS t, count(DISTINCT nostereo) AS s, count(DISTINCT skeleton) AS k FROM l GROUP BY parent) "
    "SELECT 'g' || lpad(CAST(row_number() OVER (ORDER BY size DESC, first_position) - 1 AS VARCHAR), 6, '0') AS group_id, key, size, first_position, n_exact, "
    "concat_ws(';', CASE WHEN n_exact > 1 THEN 'salt, counter-ion or charge form' END, CASE WHEN t < 1 OR k < s THEN 'tautomer' END, CASE WHEN s < 1 OR k < t THEN 'stereochemistry' END) AS differs FROM g"
)
def identity_groups(spark, sf_dir):
    found = identity.audit_groups(ladder(spark, sf_dir))
    return found.select("group_id", "key", "size", "first_position", "n_exact", F.array_join("differs_by", ";").alias("differs"))


@query(
    f"WITH {LADDER_SQL}, g AS (SELECT skeleton AS key, count(*) AS size, count(DISTINCT exact) AS e, count(DISTINCT parent) AS p, count(DISTINCT tautomer) AS t, count(DISTINCT nostereo) AS s FROM l GROUP BY skeleton HAVING count(*) > 1) "
    "SELECT key, size, concat_ws(';', CASE WHEN e > p THEN 'salt, counter-ion or charge form' END, CASE WHEN t < p OR 1 < s THEN 'tautomer' END, CASE WHEN s < p OR 1 < t THEN 'stereochemistry' END) AS differs FROM g"
)
def differs_by(spark, sf_dir):
    return identity.groups(ladder(spark, sf_dir), "skeleton").select("key", "size", F.array_join("differs_by", ";").alias("differs"))


_DUP = [f"first_value(record_id) OVER (PARTITION BY {k} ORDER BY position) AS f_{k}" for k in identity.DUPLICATE_LEVELS]


def _dup_sql() -> str:
    parts = []
    for i, k in enumerate(identity.DUPLICATE_LEVELS):
        above = "".join(f" AND NOT (f_{s} = f_{k} AND f_{s} <> record_id)" for s in identity.DUPLICATE_LEVELS[:i])
        parts.append(f"SELECT record_id, 'DUP_{k.upper()}' AS code, f_{k} AS first_record_id FROM f WHERE f_{k} <> record_id{above}")
    return f"WITH {LADDER_SQL}, f AS (SELECT record_id, {', '.join(_DUP)} FROM l) " + " UNION ALL ".join(parts)


@query(_dup_sql())
def duplicate_issues(spark, sf_dir):
    return identity.duplicate_issues(ladder(spark, sf_dir))


@query("WITH m AS (SELECT text, min(doc_id) AS f, count(*) AS size, count(DISTINCT source) AS n_sources FROM documents WHERE text IS NOT NULL GROUP BY text) SELECT f AS first_doc, size, n_sources FROM m WHERE size > 1")
def exact_text_groups(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("key"))
    return docs.groupBy("key").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("size"), F.count_distinct("source").alias("n_sources")).where("size > 1").drop("key")


# ---- leakage


@query(
    HALVES
    + " "
    + " UNION ALL ".join(f"SELECT '{k}' AS level, count(*) AS n_eval_records, count(DISTINCT {k}) AS n_eval_groups, (SELECT count(*) FROM ev) AS n_evaluation FROM ev WHERE {k} IN (SELECT {k} FROM ref)" for k in leakage.OVERLAP_LEVELS)
)
def leakage_overlap(spark, sf_dir):
    return leakage.overlap(*_halves(spark, sf_dir))


@query(HALVES + ", f AS (SELECT parent, min(record_id) AS reference_record_id FROM ref GROUP BY parent) SELECT 'parent' AS level, record_id, parent AS key, reference_record_id FROM ev JOIN f USING (parent)")
def leakage_records(spark, sf_dir):
    return leakage.overlap_rows(*_halves(spark, sf_dir), "parent").drop("position")


@query(HALVES + " SELECT count(*) AS formula_matches FROM ev WHERE formula IN (SELECT formula FROM ref)")
def formula_matches(spark, sf_dir):
    return leakage.formula_matches(*_halves(spark, sf_dir))


@query(
    f"WITH {LADDER_SQL}, s AS (SELECT record_id, CASE WHEN p_size < 5 THEN 'acyclic' ELSE tautomer || p_size END AS scaffold FROM l) "
    "SELECT count(*) AS n_cyclic, count(*) FILTER (scaffold IN (SELECT scaffold FROM s WHERE record_id % 10 <> 0)) AS n_shared FROM s WHERE record_id % 10 = 0 AND scaffold <> 'acyclic'"
)
def scaffold_overlap(spark, sf_dir):
    rows = ladder(spark, sf_dir).withColumn("scaffold", F.when(F.col("p_size") < 5, "acyclic").otherwise(F.concat("tautomer", F.col("p_size").cast("string"))))
    return leakage.scaffold_overlap(rows.where("record_id % 10 != 0"), rows.where("record_id % 10 = 0"))


@query(f"WITH {LADDER_SQL} SELECT p_brand AS split, count(*) - count(DISTINCT parent) AS n_duplicates FROM l GROUP BY p_brand")
def within_split_duplicates(spark, sf_dir):
    return leakage.within_split_duplicates(ladder(spark, sf_dir).withColumnRenamed("p_brand", "split"), "split", "parent")


_WORD = "(" + " | ".join(f"(CASE WHEN embedding[{i + 1}] > 0 THEN 1::UBIGINT << {i} ELSE 0::UBIGINT END)" for i in range(64)) + ")"
_TANIMOTO = "(bit_count(a.w & b.w)::DOUBLE / bit_count(a.w | b.w))"
WORDS = f"w AS (SELECT vec_id AS id, label, {_WORD} AS w FROM embeddings WHERE embedding IS NOT NULL)"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select(F.col("vec_id").alias("id"), "label", similarity.sign_word(F.col("embedding")).alias("fp"))


@query(
    f"WITH {WORDS}, p AS (SELECT a.id AS record_id, b.id AS reference_record_id, {_TANIMOTO} AS similarity FROM w a, w b WHERE a.id % 10 = 0 AND b.id % 10 <> 0) "
    "SELECT record_id, reference_record_id, similarity FROM p QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY similarity DESC, reference_record_id) = 1"
)
def nearest_neighbour(spark, sf_dir):
    w = words(spark, sf_dir)
    ref = w.where("id % 10 != 0").select(F.col("id").alias("ref_id"), F.col("id").alias("ref_position"), F.col("fp").alias("ref_fp"))
    return leakage.nearest(ref, w.where("id % 10 = 0").select(F.col("id").alias("record_id"), "fp"), similarity.tanimoto_word(F.col("fp"), F.col("ref_fp")))


@query(f"WITH {WORDS} SELECT a.id AS a, b.id AS b, {_TANIMOTO} AS similarity FROM w a JOIN w b ON a.id < b.id WHERE {_TANIMOTO} >= 0.55")
def similarity_pairs(spark, sf_dir):
    return cliffs.similar_pairs(words(spark, sf_dir).select("id", "fp"), 0.55)


@query(
    f"WITH {WORDS}, q AS (SELECT w FROM w WHERE id = 0), s AS (SELECT b.id, bit_count(q.w & b.w)::DOUBLE / bit_count(q.w | b.w) AS similarity FROM w b, q) "
    "SELECT row_number() OVER (ORDER BY similarity DESC, id) AS rank, id, similarity FROM s WHERE similarity >= 0.2 ORDER BY similarity DESC, id LIMIT 25"
)
def similarity_top(spark, sf_dir):
    w = words(spark, sf_dir)
    q = w.where("id = 0").select(F.col("fp").alias("q"))
    rows = w.join(F.broadcast(q)).withColumn("position", F.col("id"))
    return search.similar(rows, similarity.tanimoto_word(F.col("fp"), F.col("q")), 0.2, 25).select("rank", "id", "similarity")


@query(
    "WITH d AS (SELECT o_orderkey AS record_id, o_orderpriority AS split, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders), "
    "m AS (SELECT max(date) AS latest FROM d WHERE split = '1-URGENT') SELECT split, count(*) AS n FROM d, m WHERE split <> '1-URGENT' AND date <= latest GROUP BY split"
)
def temporal_order(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.col("o_orderpriority").alias("split"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"))
    late = leakage.temporal_violations(d.where("split = '1-URGENT'"), d.where("split != '1-URGENT'"))
    return late.groupBy("split").agg(F.count("*").alias("n"))


# ---- labels


@query("SELECT l_partkey, l_suppkey, count(*) AS n_records, count(DISTINCT l_returnflag) AS n_labels, count(DISTINCT l_returnflag) > 1 AS conflict FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2")
def label_conflicts_class(spark, sf_dir):
    return conflicts.by_class(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag")


@query(
    "SELECT o_custkey, o_orderpriority, count(*) AS n_records, count(*) AS n_exact, 0::BIGINT AS n_censored, 'absolute (unitless)' AS scale, "
    "max(o_totalprice) - min(o_totalprice) > 250000 AS conflict, CAST(max(o_totalprice) - min(o_totalprice) AS BIGINT) // 10 AS spread_10 FROM orders GROUP BY 1, 2 HAVING count(*) >= 2"
)
def label_conflicts_value(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", measure.parse(F.col("o_totalprice")).alias("m"))
    # Rounded to decimals first, 106929.49999999999 would become 106930.
    found = conflicts.by_value(rows, ["o_custkey", "o_orderpriority"], "m", 250_000, digits=None)
    return found.withColumn("spread_10", F.floor(F.bround("spread", 0) / 10).cast("long")).drop("spread")


@query(
    "WITH s AS (SELECT o_custkey, o_orderpriority, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS middle FROM orders GROUP BY 1, 2) "
    "SELECT o_custkey, count(*) AS n_sources, count(*) FILTER (n > 1) AS n_technical_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_technical_records, "
    "max(spread) FILTER (n > 1) AS technical_spread, CASE WHEN count(*) > 1 THEN max(middle) - min(middle) END AS between_source_spread FROM s GROUP BY 1"
)
def replicate_split(spark, sf_dir):
    return conflicts.replicates(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice")


_EVENTS = "e AS (SELECT event_id, user_id, event_type, value, ['', '>', '<', '~', '>='][event_id % 5 + 1] AS rel FROM events)"


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rel = F.element_at(F.array(*map(F.lit, ["", ">", "<", "~", ">="])), (F.col("event_id") % 5 + 1).cast("int"))
    return e.select("event_id", "user_id", "event_type", "value", measure.parse(F.concat(rel, F.col("value").cast("string")), F.lit("nM")).alias("m"))


@query(f"WITH {_EVENTS} SELECT event_id, coalesce(nullif(rel, ''), '=') AS relation, value, rel <> '' AS censored, CAST(floor(-log10(value * 1e-9) * 1000) AS BIGINT) AS log_milli FROM e WHERE value IS NOT NULL")
def measurement_parse(spark, sf_dir):
    rows = measurements(spark, sf_dir).where("value is not null")
    return rows.select("event_id", "m.relation", "m.value", "m.censored", F.floor(-F.log10(F.col("m.value_nm") * 1e-9) * 1000).cast("long").alias("log_milli"))


@query(
    f"WITH {_EVENTS} SELECT event_id, CASE WHEN rel IN ('', '~') OR rel IN ('>', '>=') THEN value END AS lo, CASE WHEN rel IN ('', '~', '<') THEN value END AS hi FROM e WHERE value IS NOT NULL"
)
def measurement_interval(spark, sf_dir):
    rows = measurements(spark, sf_dir).where("value is not null").withColumn("i", measure.interval(F.col("m"), molar=False))
    return rows.select("event_id", "i.lo", "i.hi")


_VALUES = (
    f"{_EVENTS}, i AS (SELECT user_id, CASE WHEN rel IN ('', '~', '>', '>=') THEN value END AS lo, CASE WHEN rel IN ('', '~', '<') THEN value END AS hi FROM e WHERE value IS NOT NULL), "
    "r AS (SELECT user_id AS id, count(*) FILTER (lo = hi) AS n_exact, count(*) FILTER (lo IS NULL OR hi IS NULL OR lo <> hi) AS n_censored, quantile_cont(lo, 0.5) FILTER (lo = hi) AS mid, "
    "max(lo) FILTER (lo = hi) - min(lo) FILTER (lo = hi) AS spread, max(lo) AS ml, min(hi) AS mh FROM i GROUP BY 1), "
    "c AS (SELECT id, n_exact, n_censored, CASE WHEN n_exact > 0 THEN spread > 400 ELSE coalesce(ml > mh, false) END AS conflict, mid, ml, mh FROM r)"
)


def values(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    # A generated row keeps the parser from being folded into each use of what it yields.
    parsed = measurements(spark, sf_dir).where("value is not null").select(*keys, F.explode(F.array("m")).alias("m"))
    rows = parsed.withColumn("i", measure.interval(F.col("m"), molar=False)).select(*keys, "i.lo", "i.hi")
    return cliffs.compound_values(rows, keys, "lo", "hi", 400.0)


@query(f"WITH {_VALUES} SELECT id AS user_id, CASE WHEN NOT conflict THEN CASE WHEN n_exact > 0 THEN mid ELSE ml END END AS lo, CASE WHEN NOT conflict THEN CASE WHEN n_exact > 0 THEN mid ELSE mh END END AS hi, n_exact, n_censored, conflict FROM c")
def compound_values(spark, sf_dir):
    return values(spark, sf_dir, ["user_id"])


_PAIRED = (
    f"WITH {WORDS}, v AS (SELECT vec_id AS id, CAST(label AS DOUBLE) AS lo, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(label AS DOUBLE) END AS hi FROM embeddings), "
    f"p AS (SELECT a.id AS a, b.id AS b FROM w a JOIN w b ON a.id < b.id WHERE {_TANIMOTO} >= 0.5), "
    "j AS (SELECT p.a, p.b, x.lo AS alo, x.hi AS ahi, y.lo AS blo, y.hi AS bhi, greatest(0, coalesce(x.lo - y.hi, 0), coalesce(y.lo - x.hi, 0)) AS least, "
    "CASE WHEN x.hi IS NOT NULL AND y.hi IS NOT NULL THEN greatest(x.hi - y.lo, y.hi - x.lo) END AS most, CASE WHEN x.hi IS NOT NULL AND y.hi IS NOT NULL THEN y.lo - x.lo END AS signed FROM p JOIN v x ON x.id = p.a JOIN v y ON y.id = p.b), "
    "k AS (SELECT *, CASE WHEN least >= 3 THEN 'cliff' WHEN most < 3 THEN 'consistent' ELSE 'undetermined' END AS verdict FROM j)"
)


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("double")
    return e.select(F.col("vec_id").alias("id"), label.alias("lo"), F.when(F.col("vec_id") % 7 != 0, label).alias("hi"))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = cliffs.similar_pairs(words(spark, sf_dir).select("id", "fp"), 0.5).select("a", "b")
    return checkpointed(cliffs.verdicts(pairs, _values(spark, sf_dir), 3.0))


@query(_PAIRED + " SELECT a, b, least, most, signed, verdict FROM k")
def cliff_pairs(spark, sf_dir):
    return _judged(spark, sf_dir).select("a", "b", "least", "most", "signed", "verdict")


@query(_PAIRED + " SELECT count(*) AS n_pairs, count(*) FILTER (verdict = 'cliff') AS n_cliff, count(*) FILTER (verdict = 'consistent') AS n_consistent, count(*) FILTER (verdict = 'undetermined') AS n_undetermined, CASE WHEN n_cliff + n_consistent > 0 THEN n_cliff / (n_cliff + n_consistent) END AS cliff_fraction FROM k")
def cliff_summary(spark, sf_dir):
    return cliffs.summary(_judged(spark, sf_dir))


@query(
    _PAIRED + ", t AS (SELECT alo % 5 AS x, blo % 5 AS y, signed, verdict FROM k) "
    "SELECT least(x, y)::BIGINT || '>>' || greatest(x, y)::BIGINT AS transformation, count(*) AS n_pairs, count(*) FILTER (verdict = 'cliff') AS n_cliff, count(*) FILTER (verdict = 'consistent') AS n_consistent, "
    "count(*) FILTER (verdict = 'undetermined') AS n_undetermined, count(signed) AS n_exact_pairs, CAST(sum(CASE WHEN x > y THEN -signed ELSE signed END) AS BIGINT) AS total_signed FROM t GROUP BY 1"
)
def transformation_summary(spark, sf_dir):
    j = _judged(spark, sf_dir).withColumn("transformation", F.concat_ws(">>", (F.col("alo") % 5).cast("long"), (F.col("blo") % 5).cast("long")))
    found = cliffs.transformations(j)
    return found.withColumn("total_signed", F.round(F.col("mean_signed") * F.col("n_exact_pairs")).cast("long")).drop("mean_signed")


@query(
    _PAIRED + ", e AS (SELECT a AS id, b AS other, verdict FROM k UNION ALL SELECT b, a, verdict FROM k), s AS (SELECT id, count(*) AS n_neighbours FROM e GROUP BY id HAVING bool_and(verdict = 'cliff') AND count(*) >= 2), "
    "n AS (SELECT e.id, e.other, v.lo, v.hi FROM e JOIN s USING (id) JOIN v ON v.id = e.other WHERE v.hi IS NOT NULL), "
    "c AS (SELECT x.id, x.other, count(*) AS c FROM n x JOIN n y ON x.id = y.id AND (y.lo > x.lo OR (y.lo = x.lo AND y.other >= x.other)) AND y.hi - x.lo < 3 GROUP BY 1, 2) "
    "SELECT s.id, n_neighbours, max(c) AS n_agreeing FROM s JOIN c USING (id) GROUP BY 1, 2 HAVING max(c) >= 2"
)
def label_outliers(spark, sf_dir):
    return cliffs.outliers(_judged(spark, sf_dir), _values(spark, sf_dir), 3.0)


@query(
    "WITH f AS (SELECT p_partkey AS id, p_brand AS context, unnest([split_part(p_name, ' ', 1) || ' ' || p_type, split_part(p_name, ' ', 2) || ' ' || p_type]) AS core, unnest([split_part(p_name, ' ', 2), split_part(p_name, ' ', 1)]) AS rest FROM part), "
    "p AS (SELECT a.context, a.id AS a, b.id AS b, a.core, a.rest AS ra, b.rest AS rb, length(a.rest) + length(b.rest) AS n, length(a.core) AS c FROM f a JOIN f b ON a.context = b.context AND a.core = b.core AND a.id < b.id AND a.rest <> b.rest) "
    "SELECT context, a, b, core, ra || '>>' || rb AS transformation, n AS n_changed FROM p QUALIFY row_number() OVER (PARTITION BY context, a, b ORDER BY n, -c, ra, rb, core) = 1"
)
def core_pairs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    core = lambda word: F.concat(word, F.lit(" "), "p_type").alias("core")
    cut = F.explode(F.array(F.struct(core(first), second.alias("rest")), F.struct(core(second), first.alias("rest"))))
    f = part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("context"), cut.alias("f")).select("id", "context", "f.core", "f.rest")
    return cliffs.core_pairs(f.withColumn("core_size", F.length("core")).withColumn("rest_size", F.length("rest")), ["context"])


# ---- libraries and splits

_DIFF = (
    f"WITH {LADDER_SQL}, a AS (SELECT parent AS key, count(*) AS n, list_sort(list(DISTINCT exact)) AS forms FROM l WHERE record_id % 2 = 0 GROUP BY parent), b AS (SELECT parent AS key, count(*) AS n, list_sort(list(DISTINCT exact)) AS forms FROM l WHERE record_id % 2 = 1 GROUP BY parent), "
    "d AS (SELECT key, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b, CASE WHEN b.n IS NULL THEN 'removed' WHEN a.n IS NULL THEN 'added' WHEN a.forms = b.forms THEN 'unchanged' ELSE 'changed' END AS status, "
    "a.n IS NOT NULL AND b.n IS NOT NULL AND a.n <> b.n AS multiplicity_changed FROM a FULL JOIN b USING (key))"
)


@query(_DIFF + " SELECT * FROM d")
def library_diff(spark, sf_dir):
    rows = ladder(spark, sf_dir)
    return diff.diff_libraries(rows.where("record_id % 2 = 0"), rows.where("record_id % 2 = 1"))


@query(_DIFF + " SELECT count(*) FILTER (status = 'added') AS n_added, count(*) FILTER (status = 'removed') AS n_removed, count(*) FILTER (status = 'changed') AS n_changed, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (multiplicity_changed) AS multiplicity_changes, count(*) FILTER (status IN ('changed', 'unchanged')) / count(*) AS jaccard FROM d")
def library_diff_summary(spark, sf_dir):
    return diff.summary(library_diff(spark, sf_dir))


@query(_DIFF + " SELECT key, 'salt, counter-ion or charge form' AS phrase FROM d WHERE status = 'changed'")
def library_change_phrases(spark, sf_dir):
    rows = ladder(spark, sf_dir)
    return diff.change_phrases(rows.where("record_id % 2 = 0"), rows.where("record_id % 2 = 1"))


def _fill_sql(key: str, source: str, cuts: tuple[float, ...], names: tuple[str, ...]) -> str:
    return (
        f"WITH g AS (SELECT {key} AS key, count(*) AS n FROM {source} GROUP BY 1), c AS (SELECT key, n, sum(n) OVER (ORDER BY key) - n AS before, sum(n) OVER () AS total FROM g), "
        f"s AS (SELECT *, min(before) FILTER (before >= total * {cuts[0]}) OVER () AS s1 FROM c) "
        f"SELECT key, n, CASE WHEN before < total * {cuts[0]} THEN '{names[0]}' WHEN before - s1 < total * {cuts[1]} THEN '{names[1]}' ELSE '{names[2]}' END AS split FROM s"
    )


@query(_fill_sql("strftime(o_orderdate, '%Y-%m-%d')", "orders", (0.7, 0.2), ("train", "valid", "test")))
def split_temporal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("key"))
    return splits.ordered_fill(rows, "key", {"train": 0.7, "valid": 0.2, "test": 0.1})


@query(_fill_sql("source", "documents WHERE source IS NOT NULL", (0.6, 0.2), ("train", "valid", "test")))
def split_source(spark, sf_dir):
    return splits.ordered_fill(table(spark, sf_dir, "documents").select(F.col("source").alias("key")), "key", {"train": 0.6, "valid": 0.2, "test": 0.2})


@query()
def split_identity(spark, sf_dir):
    return splits.greedy_fill(ladder(spark, sf_dir).select(F.col("parent").alias("key")), "key", {"train": 0.8, "test": 0.2}, seed=7)


@query("WITH g AS (SELECT CASE WHEN p_size < 5 THEN 'acyclic:' || p_partkey ELSE p_name END AS key, count(*) AS n FROM part GROUP BY 1) SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS records, min(n) AS least, list_sort(list(n))[count(*) // 2 + 1] AS middle, max(n) AS most, max(n) / CAST(sum(n) AS BIGINT) AS largest_share FROM g")
def group_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").withColumn("scaffold", F.when(F.col("p_size") < 5, "acyclic").otherwise(F.col("p_name")))
    keys = rows.select(splits.group_key("scaffold", "p_partkey", scaffold="scaffold").alias("key"))
    return splits.group_sizes(keys.groupBy("key").agg(F.count("*").alias("n")))


@query("SELECT p_brand AS split, p_type AS label, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY p_brand) AS BIGINT) AS share FROM part GROUP BY 1, 2")
def label_balance(spark, sf_dir):
    return splits.label_balance(table(spark, sf_dir, "part").select(F.col("p_brand").alias("split"), "p_type"), "p_type")


@query("SELECT p_brand AS split, count(*) AS n, min(p_size)::DOUBLE AS least, max(p_size)::DOUBLE AS most, avg(p_size) AS mean FROM part GROUP BY 1")
def endpoint_balance(spark, sf_dir):
    return splits.balance(table(spark, sf_dir, "part").select(F.col("p_brand").alias("split"), "p_size"), "p_size")


# ---- generation

_GEN = f"WITH {LADDER_SQL}, g AS (SELECT *, CASE WHEN record_id % 17 = 0 THEN 'empty' WHEN record_id % 19 = 0 THEN 'whitespace' END AS reason FROM l WHERE record_id % 2 = 0), r AS (SELECT * FROM l WHERE record_id % 2 = 1)"


def _generated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ladder(spark, sf_dir)
    made = F.when(F.col("record_id") % 17 == 0, " ").when(F.col("record_id") % 19 == 0, "C C").otherwise("CC")
    return generation.validity(rows.where("record_id % 2 = 0").withColumn("structure", made), "structure"), rows.where("record_id % 2 = 1")


@query(_GEN + " SELECT count(*) AS n, count(*) FILTER (reason IS NULL) AS n_valid, count(DISTINCT CASE WHEN reason IS NULL THEN parent END) AS n_unique FROM g")
def generation_report(spark, sf_dir):
    return generation.report(_generated(spark, sf_dir)[0], "parent")


@query(_GEN + " SELECT coalesce(reason, 'valid') AS reason, count(*) AS n FROM g GROUP BY 1")
def generation_reasons(spark, sf_dir):
    return _generated(spark, sf_dir)[0].groupBy(F.coalesce("reason", F.lit("valid")).alias("reason")).agg(F.count("*").alias("n"))


@query(_GEN + ", v AS (SELECT record_id, first_value(record_id) OVER (PARTITION BY nostereo ORDER BY position) AS f FROM g WHERE reason IS NULL) SELECT record_id, f AS duplicate_of FROM v WHERE f <> record_id")
def generation_duplicates(spark, sf_dir):
    valid = _generated(spark, sf_dir)[0].where("reason is null")
    return generation.uniqueness(valid, "nostereo").where("duplicate_of is not null").select("record_id", "duplicate_of")


@query(_GEN + " " + " UNION ALL ".join(f"SELECT '{k}' AS level, count(DISTINCT {k}) AS n_unique, count(DISTINCT CASE WHEN {k} NOT IN (SELECT {k} FROM r) THEN {k} END) AS n_novel FROM g WHERE reason IS NULL" for k in ("exact", "parent", "nostereo", "skeleton")))
def generation_novelty(spark, sf_dir):
    g, r = _generated(spark, sf_dir)
    return generation.novelty(g.where("reason is null"), r, ("exact", "parent", "nostereo", "skeleton"))


# ---- patterns over texts

CATALOGUE = ((0, "article", "the"), (1, "capital", "The"), (2, "digits", "[0-9]"), (3, "link", "http"), (4, "license", "license"), (5, "article again", "the"), (6, "digit", "[0-9]+"), (7, "apache", "Apache License"), (8, "long", "the .* of"))
CATALOGUE_B = ((0, "article", "the "), (1, "capital", "The"), (2, "numbers", "[0-9]"), (3, "link", "https?"), (4, "license", "[Ll]icense"), (5, "rights", "rights reserved"))
_PREPARED = {"raw": "text", "lower": "lower(text)"}


def _hits_sql(catalogue, name: str = "h", preparations=("raw", "lower")) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT {i} AS pattern_id, doc_id AS item_id, '{p}' AS preparation FROM documents WHERE regexp_matches({_PREPARED[p]}, '{x}')" for i, _, x in catalogue for p in preparations) + ")"


def _catalogue_sql(catalogue, name: str) -> str:
    return f"{name}(pattern_id, name, pattern) AS (VALUES " + ", ".join(f"({i}, '{n}', '{x}')" for i, n, x in catalogue) + ")"


def _catalogue(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame(list(rows), "pattern_id int, name string, pattern string")


def _prepared() -> dict:
    return {"raw": F.col("text"), "lower": F.lower("text")}


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text")


def _hits(spark: SparkSession, sf_dir: str, rows=CATALOGUE, only: str | None = None) -> DataFrame:
    preparations = {k: v for k, v in _prepared().items() if only in (None, k)}
    # Several checks read the hits: the texts are matched once.
    return checkpointed(patterns.hits(_items(spark, sf_dir), [(i, x) for i, _, x in rows], preparations))


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"))
    return ids.withColumn("preparation", F.explode(F.array(F.lit("raw"), F.lit("lower"))))


_H = "WITH " + _hits_sql(CATALOGUE)
_C = _H + ", " + _catalogue_sql(CATALOGUE, "c")


@query(_H + ", n AS (SELECT count(*) AS n_evaluated FROM documents WHERE text IS NOT NULL) SELECT pattern_id, preparation, count(*) AS n_hits, any_value(n_evaluated) AS n_evaluated, count(*) / any_value(n_evaluated) > 0.1 AS broad FROM h, n GROUP BY 1, 2")
def pattern_breadth(spark, sf_dir):
    return patterns.breadth(_hits(spark, sf_dir), _evaluated(spark, sf_dir)).select("pattern_id", "preparation", "n_hits", "n_evaluated", "broad")


@query(_C + " SELECT pattern_id, EXISTS (SELECT 1 FROM h WHERE h.pattern_id = c.pattern_id AND preparation <> 'lower') AS alive_elsewhere FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.pattern_id = c.pattern_id AND preparation = 'lower')")
def pattern_dead(spark, sf_dir):
    return patterns.dead(_catalogue(spark, CATALOGUE), _hits(spark, sf_dir), "lower")


@query("WITH " + _catalogue_sql(CATALOGUE, "c") + " SELECT a.pattern_id, min(b.pattern_id) AS duplicate_of FROM c a JOIN c b ON a.pattern = b.pattern AND b.pattern_id < a.pattern_id GROUP BY 1")
def pattern_duplicates(spark, sf_dir):
    return patterns.exact_duplicates(_catalogue(spark, CATALOGUE))


_OVER = "WITH " + _hits_sql(CATALOGUE, "h", ("raw",)) + ", n AS (SELECT pattern_id, count(*) AS n FROM h GROUP BY 1), o AS (SELECT a.pattern_id AS a, b.pattern_id AS b, count(*) AS common FROM h a JOIN h b ON a.item_id = b.item_id AND a.pattern_id <> b.pattern_id GROUP BY 1, 2), s AS (SELECT a, b, common, x.n AS na, y.n AS nb FROM o JOIN n x ON x.pattern_id = a JOIN n y ON y.pattern_id = b)"


@query(_OVER + " SELECT a AS pattern_id, min(b) AS equivalent_to FROM s WHERE common = na AND common = nb GROUP BY 1")
def pattern_equivalence(spark, sf_dir):
    return patterns.equivalent(_hits(spark, sf_dir, only="raw"))


@query(_OVER + " SELECT a AS pattern_id, b AS subsumed_by FROM s WHERE common = na AND na < nb QUALIFY row_number() OVER (PARTITION BY a ORDER BY nb, b) = 1")
def pattern_subsumption(spark, sf_dir):
    return patterns.subsumed(_hits(spark, sf_dir, only="raw"))


@query(
    _H + ", f AS (SELECT d.doc_id, p.preparation, EXISTS (SELECT 1 FROM h WHERE h.item_id = d.doc_id AND h.preparation = p.preparation) AS flag FROM documents d, (VALUES ('raw'), ('lower')) p(preparation) WHERE text IS NOT NULL), "
    "x AS (SELECT preparation, count(*) AS n_hits, count(DISTINCT pattern_id) AS n_firing FROM h GROUP BY 1) "
    "SELECT f.preparation, count(*) FILTER (f.flag) AS n_flagged, any_value(n_hits) AS n_hits, any_value(n_firing) AS n_firing, count(*) FILTER (f.flag <> g.flag) AS n_flips FROM f JOIN f g ON f.doc_id = g.doc_id AND g.preparation = 'raw' JOIN x ON x.preparation = f.preparation GROUP BY 1"
)
def pattern_sensitivity(spark, sf_dir):
    return patterns.sensitivity(_hits(spark, sf_dir), _evaluated(spark, sf_dir), "raw")


@query(_H + " SELECT pattern_id, preparation, array_to_string(list_sort(list(item_id))[1:3], ',') AS examples FROM h GROUP BY 1, 2")
def pattern_examples(spark, sf_dir):
    return patterns.examples(_hits(spark, sf_dir)).withColumn("examples", F.array_join(F.col("examples").cast("array<string>"), ","))


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return _catalogue(spark, CATALOGUE), _catalogue(spark, CATALOGUE_B), _hits(spark, sf_dir, CATALOGUE, "raw"), _hits(spark, sf_dir, CATALOGUE_B, "raw")


_TWO = "WITH " + ", ".join([_hits_sql(CATALOGUE, "ha", ("raw",)), _hits_sql(CATALOGUE_B, "hb", ("raw",)), _catalogue_sql(CATALOGUE, "ca"), _catalogue_sql(CATALOGUE_B, "cb")])


def _pairs_sql() -> str:
    sets = "sa AS (SELECT pattern_id, list_sort(list(item_id)) AS hit_set FROM ha GROUP BY 1), sb AS (SELECT pattern_id, list_sort(list(item_id)) AS hit_set FROM hb GROUP BY 1), a0 AS (SELECT * FROM ca LEFT JOIN sa USING (pattern_id)), b0 AS (SELECT * FROM cb LEFT JOIN sb USING (pattern_id))"
    out = [sets]
    for i, (key, how) in enumerate((("name", "name"), ("pattern", "pattern"), ("hit_set", "hits"))):
        nth = lambda s: f"(SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY pattern_id) AS n FROM {s}{i} WHERE {key} IS NOT NULL)"  # noqa: B023, E731
        out.append(f"m{i} AS (SELECT x.pattern_id AS a, y.pattern_id AS b, '{how}' AS paired_by FROM {nth('a')} x JOIN {nth('b')} y ON x.{key} = y.{key} AND x.n = y.n)")
        out.append(f"a{i + 1} AS (SELECT * FROM a{i} WHERE pattern_id NOT IN (SELECT a FROM m{i}))")
        out.append(f"b{i + 1} AS (SELECT * FROM b{i} WHERE pattern_id NOT IN (SELECT b FROM m{i}))")
    out.append("p AS (SELECT * FROM m0 UNION ALL SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT pattern_id, NULL, 'removed' FROM a3 UNION ALL SELECT NULL, pattern_id, 'added' FROM b3)")
    return _TWO + ", " + ", ".join(out)


@query(
    _pairs_sql() + ", q AS (SELECT p.*, (SELECT count(*) FROM ha WHERE ha.pattern_id = p.a AND ha.item_id NOT IN (SELECT item_id FROM hb WHERE hb.pattern_id = p.b)) AS only_a, "
    "(SELECT count(*) FROM hb WHERE hb.pattern_id = p.b AND hb.item_id NOT IN (SELECT item_id FROM ha WHERE ha.pattern_id = p.a)) AS only_b, (SELECT count(*) FROM ha JOIN hb USING (item_id) WHERE ha.pattern_id = p.a AND hb.pattern_id = p.b) AS common FROM p) "
    "SELECT a, b, paired_by, only_a, only_b, common, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' WHEN only_a = 0 AND only_b = 0 THEN 'same' WHEN common = 0 AND only_b = 0 THEN 'broken' "
    "WHEN common = 0 AND only_a = 0 THEN 'repaired' WHEN only_a = 0 THEN 'broadened' WHEN only_b = 0 THEN 'narrowed' ELSE 'shifted' END AS behaviour FROM q"
)
def catalogue_diff(spark, sf_dir):
    a, b, ha, hb = _two(spark, sf_dir)
    return patterns.behaviour(patterns.pair_catalogues(a, b, ha, hb), ha, hb)


@query(_TWO + ", f AS (SELECT doc_id IN (SELECT item_id FROM ha) AS a, doc_id IN (SELECT item_id FROM hb) AS b FROM documents) SELECT count(*) AS n_items, count(*) FILTER (a) AS n_flagged_a, count(*) FILTER (b) AS n_flagged_b, count(*) FILTER (a AND NOT b) AS n_only_a, count(*) FILTER (b AND NOT a) AS n_only_b FROM f")
def catalogue_verdicts(spark, sf_dir):
    _, _, ha, hb = _two(spark, sf_dir)
    return patterns.verdict_changes(_items(spark, sf_dir), ha, hb)


@query(
    _OVER + ", " + _catalogue_sql(CATALOGUE, "c") + ", d AS (SELECT a.pattern_id, min(b.pattern_id) AS d FROM c a JOIN c b ON a.pattern = b.pattern AND b.pattern_id < a.pattern_id GROUP BY 1), "
    "e AS (SELECT a AS pattern_id, min(b) AS e FROM s WHERE common = na AND common = nb GROUP BY 1), u AS (SELECT a AS pattern_id, b AS u FROM s WHERE common = na AND na < nb QUALIFY row_number() OVER (PARTITION BY a ORDER BY nb, b) = 1), "
    "z AS (SELECT c.pattern_id, d, CASE WHEN e < c.pattern_id THEN e END AS e, u FROM c LEFT JOIN d USING (pattern_id) LEFT JOIN e USING (pattern_id) LEFT JOIN u USING (pattern_id)) "
    "SELECT pattern_id, CASE WHEN d IS NOT NULL THEN 'remove' WHEN coalesce(e, u) IS NOT NULL THEN 'review' ELSE 'keep' END AS action, coalesce(d, e, u) AS because_of FROM z"
)
def catalogue_cleanup(spark, sf_dir):
    return patterns.cleanup(_catalogue(spark, CATALOGUE), _hits(spark, sf_dir, only="raw"))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def contamination(spark, sf_dir):
    """Documents that hold a whole benchmark text: those with its longest inner word, then exactly."""
    words = F.array_distinct(F.split(F.col("text"), r"\s+"))
    inner = F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    bench = table(spark, sf_dir, "benchmark").where("trim(text) != ''").select("item_id", F.col("text").alias("passage"), F.split(F.trim("text"), r"\s+").alias("w"))
    bench = bench.select("item_id", "passage", longest.alias("word"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    seeds = docs.select("doc_id", F.explode(words).alias("word")).join(bench.where("word is not null").select("item_id", "word"), "word").select("doc_id", "item_id")
    near = docs.join(seeds, "doc_id").join(bench.select("item_id", "passage"), "item_id")
    short = bench.where("word is null").select("item_id", "passage")
    met = near.where(F.contains("text", "passage")).select("doc_id", "item_id")
    few = docs.join(F.broadcast(short), F.contains(F.col("text"), F.col("passage"))).select("doc_id", "item_id")
    return met.unionByName(few)


# ---- rules, audit, export


@query("SELECT p_partkey, CASE WHEN p_size > 40 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1400 THEN 1 ELSE 0 END AS n_violations, p_size BETWEEN 5 AND 30 AND p_retailprice <= 1500 AS passes FROM part")
def rule_filters(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    columns = {"size": F.col("p_size"), "price": F.col("p_retailprice")}
    bad = rules.violations([("size", None, 40), ("price", None, 1400)], columns)
    return part.select("p_partkey", F.size(bad).alias("n_violations"), rules.passes({"size": (5, 30), "price": (None, 1500)}, columns).alias("passes"))


@query("SELECT 'p_size' AS name, count(p_size) AS n, min(p_size)::DOUBLE AS least, quantile_cont(p_size::DOUBLE, 0.5) AS median, max(p_size)::DOUBLE AS most, round(avg(p_size), 6) AS mean FROM part UNION ALL SELECT 'p_retailprice', count(p_retailprice), min(p_retailprice), quantile_cont(p_retailprice, 0.5), max(p_retailprice), round(avg(p_retailprice), 6) FROM part")
def descriptor_summary(spark, sf_dir):
    return audit.descriptor_summary(table(spark, sf_dir, "part"), ["p_size", "p_retailprice"]).withColumn("mean", F.round("mean", 6))


_STATUS = "CASE WHEN record_id % 17 = 0 THEN 'empty' WHEN record_id % 23 = 0 THEN 'invalid' ELSE 'ok' END"
_FLAGGED = f"WITH {LADDER_SQL}, r AS (SELECT *, {_STATUS} AS status FROM l), i AS (SELECT record_id, 'PARSE_EMPTY' AS code, 'warning' AS severity FROM r WHERE status = 'empty' UNION ALL SELECT record_id, 'PARSE_INVALID', 'error' FROM r WHERE status = 'invalid' UNION ALL SELECT record_id, 'DESC_MW_HIGH', 'info' FROM r WHERE p_retailprice > 1400 UNION ALL SELECT record_id, 'DESC_TINY', 'warning' FROM r WHERE p_size < 3)"


def _flagged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = ladder(spark, sf_dir).withColumn("status", F.when(F.col("record_id") % 17 == 0, "empty").when(F.col("record_id") % 23 == 0, "invalid").otherwise("ok"))
    c = F.col
    found = audit.annotate(rows, {"PARSE_EMPTY": c("status") == "empty", "PARSE_INVALID": c("status") == "invalid", "DESC_MW_HIGH": c("p_retailprice") > 1400, "DESC_TINY": c("p_size") < 3, "ISOTOPE": c("p_size") < 9})
    return rows, audit.with_severity(found, {"DESC_TINY": "warning", "ISOTOPE": "ignore"})


@query(_FLAGGED + " SELECT code, severity, count(*) AS n, count(DISTINCT record_id) AS n_records FROM i GROUP BY 1, 2")
def issue_rollup(spark, sf_dir):
    return audit.rollup(_flagged(spark, sf_dir)[1])


@query(_FLAGGED + ", m AS (SELECT r.record_id, coalesce(max(CASE severity WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'info' THEN 1 END), 0) AS k FROM r LEFT JOIN i USING (record_id) GROUP BY 1) SELECT ['none', 'info', 'warning', 'error'][k + 1] AS max_severity, count(*) AS n FROM m GROUP BY 1")
def records_by_severity(spark, sf_dir):
    return audit.max_severity(*_flagged(spark, sf_dir))


_SPLIT = (
    f"WITH {LADDER_SQL}, s AS (SELECT *, CASE WHEN record_id % 97 = 0 THEN NULL WHEN p_size > 35 THEN 'test' ELSE 'train' END AS split, CASE WHEN p_size > 35 THEN record_id * 37 % 1000 ELSE record_id * 37 % 600 END + 1000 AS day FROM l), "
    "ref AS (SELECT * FROM s WHERE split = 'train'), ev AS (SELECT * FROM s WHERE split = 'test'), o AS (SELECT record_id FROM ev WHERE parent IN (SELECT parent FROM ref)), "
    "x AS (SELECT record_id, 'SPLIT_MISSING' AS code FROM s WHERE split IS NULL UNION ALL SELECT record_id, 'SPLIT_OVERLAP' FROM o "
    "UNION ALL SELECT record_id, 'SPLIT_RELATED' FROM ev WHERE p_brand <> 'acyclic' AND p_brand IN (SELECT p_brand FROM ref) AND record_id NOT IN (SELECT record_id FROM o) "
    "UNION ALL SELECT record_id, 'TEMPORAL_ORDER' FROM ev WHERE day <= (SELECT max(day) FROM ref))"
)


def _split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, test = F.col, F.col("p_size") > 35
    day = F.when(test, c("record_id") * 37 % 1000).otherwise(c("record_id") * 37 % 600) + 1000
    return ladder(spark, sf_dir).withColumns({"split": F.when(c("record_id") % 97 != 0, F.when(test, "test").otherwise("train")), "date": day.cast("string"), "scaffold": c("p_brand")})


@query(_SPLIT + " SELECT * FROM x")
def split_issues(spark, sf_dir):
    return audit.split_issues(_split_rows(spark, sf_dir))


_LABELLED = "d AS (SELECT doc_id AS record_id, md5(text) AS key, source FROM documents WHERE text IS NOT NULL AND trim(coalesce(source, '')) <> ''), c AS (SELECT record_id, 'LABEL_CONFLICT' AS code FROM d WHERE key IN (SELECT key FROM d GROUP BY key HAVING count(DISTINCT trim(source)) > 1))"


def _label_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.label_issues(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.md5("text").alias("key"), "source"), ["key"], "source")


@query(f"WITH {_LABELLED} SELECT * FROM c")
def label_issues(spark, sf_dir):
    return _label_rows(spark, sf_dir)


_GATES = {"severity": {"fail_on": "error"}, "invalid": {"most_invalid": 0.05}, "duplicates": {"most_duplicates": 0.05}, "overlap": {"no_overlap": True}, "conflicts": {"no_conflicts": True}, "complete": {"complete": True}, "lenient": {"most_invalid": 0.9, "most_duplicates": 0.9}}


@query(
    _SPLIT + f", {_LABELLED}, " + _FLAGGED.removeprefix(f"WITH {LADDER_SQL}, ")
    + ", n AS (SELECT count(*) AS n, count(*) FILTER (status <> 'ok') AS n_unusable, (SELECT count(*) FROM i WHERE severity = 'error') + (SELECT count(*) FROM o) + count(*) FILTER (record_id % 501 = 0) AS n_severe, "
    "(SELECT count(*) FROM o) AS n_overlap, (SELECT count(*) FROM c) AS n_conflicts, count(*) FILTER (record_id % 501 = 0) AS n_failed, count(*) - count(DISTINCT parent) AS n_collapsed FROM r), "
    "g AS (SELECT unnest(['severity', 'invalid', 'duplicates', 'overlap', 'conflicts', 'complete', 'lenient']) AS gate) "
    "SELECT gate, n, n_unusable, CASE WHEN gate = 'severity' THEN n_severe ELSE 0 END AS n_severe, n_overlap, n_conflicts, n_failed, CASE gate WHEN 'severity' THEN CASE WHEN n_severe > 0 THEN 3 ELSE 0 END WHEN 'invalid' THEN CASE WHEN n_unusable > 0.05 * n THEN 3 ELSE 0 END "
    "WHEN 'duplicates' THEN CASE WHEN n_collapsed > 0.05 * n THEN 3 ELSE 0 END WHEN 'overlap' THEN CASE WHEN n_overlap > 0 THEN 3 ELSE 0 END WHEN 'conflicts' THEN CASE WHEN n_conflicts > 0 THEN 3 ELSE 0 END "
    "WHEN 'complete' THEN CASE WHEN n_failed > 0 THEN 4 ELSE 0 END ELSE CASE WHEN n_unusable > 0.9 * n OR n_collapsed > 0.9 * n THEN 3 ELSE 0 END END AS exit_code FROM g, n"
)
def gates(spark, sf_dir):
    rows, issues = _flagged(spark, sf_dir)
    failed = rows.where("record_id % 501 = 0").select("record_id", F.lit("STD_FAILED").alias("code"))
    more = audit.split_issues(_split_rows(spark, sf_dir)).unionByName(_label_rows(spark, sf_dir)).unionByName(failed)
    issues = checkpointed(issues.select("record_id", "code", "severity").unionByName(audit.with_severity(more).select("record_id", "code", "severity")))
    out = None
    for name, gate in _GATES.items():
        one = audit.evaluate(audit.Gates(**gate), rows, issues).select(F.lit(name).alias("gate"), "n", "n_unusable", "n_severe", "n_overlap", "n_conflicts", "n_failed", "exit_code")
        out = one if out is None else out.unionByName(one)
    return out


@query(_FLAGGED + " SELECT r.record_id, concat_ws(';', CASE WHEN status <> 'ok' THEN 'status:' || status END, (SELECT string_agg(code, ';' ORDER BY code) FROM i WHERE i.record_id = r.record_id AND (severity = 'error' OR code = 'DESC_TINY'))) AS reasons FROM r")
def clean_export(spark, sf_dir):
    rows, issues = _flagged(spark, sf_dir)
    return audit.clean_and_excluded(rows, issues, codes=("DESC_TINY",)).select("record_id", F.array_join("reasons", ";").alias("reasons"))


@query(_FLAGGED + " SELECT count(*) AS n_records, count(DISTINCT exact) AS n_exact FROM r WHERE status = 'ok'")
def audit_levels(spark, sf_dir):
    rows = _flagged(spark, sf_dir)[0]
    return audit.audit(rows)["levels"].select(F.col("n").alias("n_records"), "n_exact")


# ---- sources that answer the same query: copies of a text as answers

_ANSWERS = "a AS (SELECT md5(text) AS query, doc_id, source, CAST(substr(source, 4) AS INTEGER) AS priority, lang AS exact, source || lang AS parent, length(text) // 100 AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null and source is not null")
    return docs.select(F.md5("text").alias("query"), "doc_id", "source", F.substring("source", 4, 9).cast("int").alias("priority"), F.col("lang").alias("exact"), F.concat("source", "lang").alias("parent"))


@query(f"WITH {_ANSWERS}, v AS (SELECT query, parent, count(DISTINCT source) AS n, min(priority) AS p FROM a WHERE parent IS NOT NULL GROUP BY 1, 2) SELECT query, parent, n AS n_sources FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, p, parent) = 1")
def consensus(spark, sf_dir):
    return merge.consensus(answers(spark, sf_dir), "parent")


@query(f"WITH {_ANSWERS} SELECT query, arg_min(parent, struct_pack(p := priority, v := parent)) AS parent, arg_min(source, struct_pack(p := priority, v := parent)) AS parent_source FROM a WHERE trim(coalesce(parent, '')) <> '' GROUP BY 1")
def merged(spark, sf_dir):
    return merge.merged(answers(spark, sf_dir), ["parent"])


@query(f"WITH {_ANSWERS} SELECT query, count(DISTINCT source) AS n_sources, CASE WHEN count(DISTINCT parent) = 1 AND count(parent) = count(*) THEN 'parent' WHEN count(DISTINCT exact) = 1 AND count(exact) = count(*) THEN 'exact' END AS level FROM a GROUP BY 1")
def agreement(spark, sf_dir):
    return merge.agreement(answers(spark, sf_dir), ("parent", "exact"))


_AGREED = "g AS (SELECT query, count(DISTINCT source) AS n, CASE WHEN count(DISTINCT parent) = 1 AND count(parent) = count(*) THEN 'parent' WHEN count(DISTINCT exact) = 1 AND count(exact) = count(*) THEN 'exact' END AS level FROM a GROUP BY 1)"


@query(f"WITH {_ANSWERS}, {_AGREED} SELECT CASE WHEN n = 1 THEN 'one source' ELSE coalesce(level, 'none') END AS outcome, count(*) AS n, count(*) FILTER (n = 2) AS n_complete FROM g GROUP BY 1")
def concordance(spark, sf_dir):
    a = answers(spark, sf_dir)
    return merge.concordance(a, a.select("query"), 2, ("parent", "exact"))


@query(f"WITH {_ANSWERS}, p AS (SELECT DISTINCT query, source, priority, exact, parent FROM a) SELECT x.query, x.source AS source_a, y.source AS source_b, CASE WHEN x.parent = y.parent THEN 'parent' WHEN x.exact = y.exact THEN 'exact' END AS level FROM p x JOIN p y ON x.query = y.query AND x.priority < y.priority")
def source_differences(spark, sf_dir):
    a = answers(spark, sf_dir).select("query", "source", "priority", "exact", "parent").distinct()
    return merge.differences(a, ("parent", "exact"))


@query("SELECT event_type AS source, user_id, max(value) AS value, max(event_id) AS event_id FROM (SELECT event_type, user_id, event_id, arg_max(value, event_id) OVER (PARTITION BY event_type, user_id) AS value FROM events) GROUP BY 1, 2")
def cache_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), "user_id", "event_id", "value")
    return merge.upserted(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["source", "user_id"], "event_id")


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'id' ELSE 'name' END AS route, count(*) AS n FROM part GROUP BY 1")
def query_router(spark, sf_dir):
    q = table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_partkey").cast("string"))).otherwise(F.col("p_name")).alias("query"))
    return merge.routed(q).groupBy("route").agg(F.count("*").alias("n"))


@query("SELECT lower(trim(p_name)) AS name, min(p_partkey) AS position, CASE WHEN length(any_value(trim(p_name))) % 2 = 0 THEN 'cache' ELSE 'table' END AS origin FROM part GROUP BY 1")
def lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.concat(F.lit("name:"), F.lower(F.trim("p_name"))).alias("query_key"), F.length(F.trim("p_name")).alias("value")).distinct()
    found = merge.lookup(part.select(F.col("p_name").alias("query"), F.col("p_partkey").alias("position")), names.where("value % 2 = 0"), names)
    return found.select(F.substring("query_key", 6, 1000).alias("name"), "position", "origin")


@query("SELECT conv_id, turn, unnest(regexp_split_to_array(trim(role || ' ' || turn), ' ')) AS part FROM conversations")
def exploded(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.concat_ws(" ", "role", F.col("turn").cast("string")), " ").alias("parts"))
    return search.exploded(c, "parts", "part")


@query("SELECT count(*) AS n FROM part WHERE NOT (p_size BETWEEN 5 AND 30)")
def batch_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return search.batch_filter(part, rules.passes({"size": (5, 30)}, {"size": F.col("p_size")}), failing=True).agg(F.count("*").alias("n"))
