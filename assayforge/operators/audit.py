"""Issues of records, their rollups, gates, and itemised clean exports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.functions import measure
from assayforge.operators import conflicts, identity, leakage

#: Issue codes and their severities.
ISSUES = {
    "PARSE_EMPTY": "warning", "PARSE_WHITESPACE": "error", "PARSE_INVALID": "error", "SDF_PARSE_FAILED": "error", "REPAIR_CANDIDATE": "info",
    "STD_CHANGED_TEXT": "info", "STD_CHANGED_IDENTITY": "warning", "STD_FAILED": "error", "FRAG_MULTIPLE": "info", "FRAG_MULTIPLE_ORGANIC": "warning",
    "CHARGE_NET": "info", "ISOTOPE": "info", "STEREO_UNASSIGNED": "info", "STEREO_PARTIAL": "warning", "ELEMENT_UNUSUAL": "info",
    "DESC_MW_HIGH": "info", "DESC_TINY": "info", "DUP_EXACT": "warning", "DUP_PARENT": "warning", "DUP_TAUTOMER": "info",
    "DUP_NOSTEREO": "info", "DUP_SKELETON": "info", "ALERT_MATCH": "info", "LABEL_CONFLICT": "warning", "ACTIVITY_CLIFF": "info",
    "LABEL_OUTLIER": "warning", "UNITS_MISSING": "warning", "RELATION_CENSORED": "info", "SPLIT_OVERLAP": "error", "SPLIT_RELATED": "info",
    "SPLIT_MISSING": "warning", "TEMPORAL_ORDER": "warning",
}
RANK = {"info": 1, "warning": 2, "error": 3}


def catalogue(overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Severity of each code under a policy; "ignore" takes a code out."""
    return {code: s for code, s in (ISSUES | (overrides or {})).items() if s != "ignore"}


def with_severity(issues: DataFrame, overrides: dict[str, str] | None = None) -> DataFrame:
    """Issues (record_id, code, ...) with their severity; ignored and unknown codes go."""
    known = F.create_map(*[F.lit(x) for kv in catalogue(overrides).items() for x in kv])
    return issues.withColumn("severity", F.element_at(known, F.col("code"))).where("severity is not null")


def _rank(c: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in RANK.items() for x in kv]), c), F.lit(0))


def flags(columns: dict[str, Column]) -> Column:
    """Array of the codes whose condition holds."""
    return F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in columns.items())))


def annotate(records: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(record_id, code) of every condition that holds."""
    return records.select("record_id", F.explode(flags(conditions)).alias("code"))


def record_conditions(usual_elements: tuple[str, ...] = ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Se", "Br", "I")) -> dict[str, Column]:
    """Conditions on the columns that the chemistry kernel adds; a missing column value is no finding."""
    c = F.col
    return {
        "PARSE_EMPTY": c("status") == "empty",
        "PARSE_WHITESPACE": (c("status") == "invalid") & c("inner_space"),
        "PARSE_INVALID": (c("status") == "invalid") & ~c("inner_space"),
        "REPAIR_CANDIDATE": (c("status") == "invalid") & c("repair").isNotNull(),
        "STD_FAILED": c("std_error").isNotNull(),
        "STD_CHANGED_IDENTITY": c("std_changed"),
        "FRAG_MULTIPLE": c("n_fragments") > 1,
        "FRAG_MULTIPLE_ORGANIC": c("n_organic") > 1,
        "CHARGE_NET": c("charge") != 0,
        "ISOTOPE": c("has_isotope"),
        "STEREO_UNASSIGNED": (c("n_stereo") > 0) & (c("n_assigned") == 0),
        "STEREO_PARTIAL": (c("n_assigned") > 0) & (c("n_assigned") < c("n_stereo")),
        "ELEMENT_UNUSUAL": F.size(F.array_except(c("elements"), F.lit(list(usual_elements)))) > 0,
        "DESC_MW_HIGH": c("mw") > 1000,
        "DESC_TINY": c("heavy_atoms") < 3,
    }


def split_issues(records: DataFrame, level: str = "parent", threshold: float = 0.7, similarity: Column | None = None) -> DataFrame:
    """(record_id, code) of what a split column shows among readable records.

    The largest split is the reference. A record of another one overlaps if the
    reference has its key at the level, else is related if its nearest neighbour by
    ``similarity`` (of the columns fp and ref_fp) reaches the threshold, else if the
    reference has its scaffold; it is out of order if dated no later than the latest
    reference date. scaffold, date and fp are looked at where there are such columns.
    """
    missing = records.where("split is null").select("record_id", F.lit("SPLIT_MISSING").alias("code"))
    first = leakage.reference_split(records, "split")
    if first is None:
        return missing
    reference, others = records.where(F.col("split") == first), records.where(F.col("split") != first)
    over = leakage.overlap_rows(reference, others, level).select("record_id").distinct()
    parts = [over.withColumn("code", F.lit("SPLIT_OVERLAP"))]
    close = []
    if similarity is not None:
        known = reference.where("fp is not null").select(F.col("record_id").alias("ref_id"), F.col("position").alias("ref_position"), F.col("fp").alias("ref_fp"))
        near = leakage.nearest(known, others.where("fp is not null"), similarity)
        close.append(leakage.related(near, over, threshold).select("record_id"))
    if "scaffold" in records.columns:
        known = reference.where("scaffold != 'acyclic'").select("scaffold").distinct()
        close.append(others.join(known, "scaffold", "left_semi").join(over, "record_id", "left_anti").select("record_id"))
    if close:
        rows = close[0] if len(close) == 1 else close[0].unionByName(close[1])
        parts.append(rows.distinct().withColumn("code", F.lit("SPLIT_RELATED")))
    if "date" in records.columns:
        parts.append(leakage.temporal_violations(reference, others).select("record_id", F.lit("TEMPORAL_ORDER").alias("code")))
    for p in parts:
        missing = missing.unionByName(p)
    return missing


def label_issues(records: DataFrame, keys: list[str], endpoint: str, units: str | None = None, parsed: str | None = None, tolerance: float = 1.0) -> DataFrame:
    """(record_id, code) of labels of records that share the keys.

    With ``parsed``, the measurement column, spreads beyond the tolerance conflict,
    censored values of groups of two or more are named, and so are values without
    units; else different labels conflict.
    """
    text = F.trim(F.col(endpoint).cast("string"))
    rows = records.where(F.coalesce(text, F.lit("")) != "")
    keyed = rows
    for k in keys:
        keyed = keyed.where(F.col(k).isNotNull())
    keyed, keys = keyed.withColumn("_key", F.struct(*keys)), ["_key"]  # a level's name can be that of a column within
    found = conflicts.by_value(keyed, keys, parsed, tolerance) if parsed else conflicts.by_class(keyed, keys, endpoint)
    issues = keyed.join(found.where("conflict").select(*keys), keys, "left_semi").select("record_id", F.lit("LABEL_CONFLICT").alias("code"))
    if parsed:
        several = found.select(*keys)
        issues = issues.unionByName(keyed.where(F.col(parsed)["censored"]).join(several, keys, "left_semi").select("record_id", F.lit("RELATION_CENSORED").alias("code")))
    if parsed and units:
        bare = rows.where(measure.is_measurement(text) & (F.coalesce(F.trim(units), F.lit("")) == ""))
        issues = issues.unionByName(bare.select("record_id", F.lit("UNITS_MISSING").alias("code")))
    return issues


def rollup(issues: DataFrame) -> DataFrame:
    """(code, severity, n, n_records)."""
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"), F.count_distinct("record_id").alias("n_records"))


def by_severity(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count("*").alias("n"))


def max_severity(records: DataFrame, issues: DataFrame) -> DataFrame:
    """(max_severity, n): records by their worst issue, "none" for those without."""
    worst = issues.groupBy("record_id").agg(F.max(_rank(F.col("severity"))).alias("_rank"))
    rank = F.coalesce("_rank", F.lit(0))
    name = F.when(rank == 0, "none")
    for s, n in RANK.items():
        name = name.when(rank == n, s)
    return records.select("record_id").join(worst, "record_id", "left").groupBy(name.alias("max_severity")).agg(F.count("*").alias("n"))


def alert_sets(alerts: DataFrame) -> DataFrame:
    """(alert_set, n_records): records, not hits."""
    return alerts.where("alert_set is not null").groupBy("alert_set").agg(F.count_distinct("record_id").alias("n_records"))


def descriptor_summary(records: DataFrame, names: list[str]) -> DataFrame:
    """One row a descriptor: n, least, interpolated median, most, mean."""
    long = records.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("v")) for n in names))).alias("d")).where("d.v is not null")
    return long.groupBy(F.col("d.name").alias("name")).agg(
        F.count("*").alias("n"), F.min("d.v").alias("least"), F.percentile("d.v", 0.5).alias("median"), F.max("d.v").alias("most"), F.avg("d.v").alias("mean")
    )


@dataclass
class Gates:
    """What an audit must hold to pass; None or False: no such gate."""

    fail_on: str | None = None
    most_invalid: float | None = None
    most_duplicates: float | None = None
    no_overlap: bool = False
    no_conflicts: bool = False
    complete: bool = False


def evaluate(gates: Gates, records: DataFrame, issues: DataFrame, level: str = "parent") -> DataFrame:
    """One row: the counts that gates look at, violated, partial, exit_code.

    The exit code is 3 if a gate is violated, 4 if processing had to be complete
    and was not (a failed standardisation), else 0. Shares are of all records for
    unusable ones and of records with a key for collapsed ones.
    """
    key = F.col(level)
    some = records.agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("empty", "invalid", "error")).alias("n_unusable"), F.count(key).alias("n_keyed"), F.count_distinct(key).alias("n_groups"))
    severe = _rank(F.col("severity")) >= RANK[gates.fail_on] if gates.fail_on else F.lit(False)
    has = lambda code: F.count_if(F.col("code") == code)
    found = issues.agg(F.count_if(severe).alias("n_severe"), has("SPLIT_OVERLAP").alias("n_overlap"), has("LABEL_CONFLICT").alias("n_conflicts"), has("STD_FAILED").alias("n_failed"))
    one = some.join(F.broadcast(found))
    broken = [F.when(F.col("n_severe") > 0, "severity")]
    if gates.most_invalid is not None:
        broken.append(F.when((F.col("n") > 0) & (F.col("n_unusable") > gates.most_invalid * F.col("n")), "invalid"))
    if gates.most_duplicates is not None:
        broken.append(F.when((F.col("n_keyed") > 0) & (F.col("n_keyed") - F.col("n_groups") > gates.most_duplicates * F.col("n_keyed")), "duplicates"))
    if gates.no_overlap:
        broken.append(F.when(F.col("n_overlap") > 0, "overlap"))
    if gates.no_conflicts:
        broken.append(F.when(F.col("n_conflicts") > 0, "conflicts"))
    violated = F.array_compact(F.array(*broken))
    partial = F.col("n_failed") > 0
    code = F.when(F.size(violated) > 0, 3).when(partial & F.lit(gates.complete), 4).otherwise(0)
    return one.withColumn("violated", violated).withColumn("partial", partial).withColumn("exit_code", code)


def clean_and_excluded(records: DataFrame, issues: DataFrame, codes: tuple[str, ...] = (), severity: str | None = "error", keep_status: tuple[str, ...] = ("ok",)) -> DataFrame:
    """Every record with ``reasons``: empty for those that a clean export keeps.

    A record goes for its status, for an issue of a listed code, or for one of at
    least the severity. Both sides add up to the input.
    """
    bad = F.col("code").isin(*codes) if codes else F.lit(False)
    if severity:
        bad = bad | (_rank(F.col("severity")) >= RANK[severity])
    why = issues.where(bad).groupBy("record_id").agg(F.sort_array(F.collect_set("code")).alias("_codes"))
    status = F.when(~F.col("status").isin(*keep_status), F.array(F.concat(F.lit("status:"), F.col("status")))).otherwise(F.array())
    return records.join(why, "record_id", "left").withColumn("reasons", F.concat(status, F.coalesce("_codes", F.array()))).drop("_codes")


#: Columns without which a condition is not looked at.
NEEDED = {"PARSE_WHITESPACE": ("inner_space",), "PARSE_INVALID": ("inner_space",), "PARSE_EMPTY": ("inner_space",), "REPAIR_CANDIDATE": ("repair",), "STD_FAILED": ("std_error",), "STD_CHANGED_IDENTITY": ("std_changed",)}


def audit(records: DataFrame, overrides: dict[str, str] | None = None, level: str = "parent", more: DataFrame | None = None) -> dict[str, DataFrame]:
    """The lazy parts of an audit over records with status, position, the ladder and, where
    they have them, the kernel's columns: issues, groups, rollups. more: (record_id, code)
    of what else was found, on splits, labels and alerts."""
    valid = records.where("status = 'ok'")
    issues = identity.duplicate_issues(valid).select("record_id", "code")
    if more is not None:
        issues = issues.unionByName(more)
    conditions = {k: v for k, v in record_conditions().items() if set(NEEDED.get(k, ("mw", "elements", "n_stereo"))) <= set(records.columns)}
    if conditions:
        issues = issues.unionByName(annotate(records, conditions))
    issues = with_severity(issues, overrides)
    return {
        "accounting": identity.accounting(records),
        "issues": issues,
        "rollup": rollup(issues),
        "by_severity": by_severity(issues),
        "max_severity": max_severity(records, issues),
        "groups": identity.audit_groups(valid, level),
        "levels": identity.distinct_per_level(valid),
    }
