"""The command surface: each command reads files and yields one or more tables.

    python -m assayforge.plans.commands audit library.csv --out results/

Commands that need a network, a force field or a drawing toolkit are absent; they
say so when asked for.
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayforge.functions import chem, measure, rules
from assayforge.functions.numbering import checkpointed
from assayforge.functions.similarity import tanimoto
from assayforge.operators import audit, cliffs, conflicts, diff, generation, identity, leakage, merge, patterns, proof, search, splits
from assayforge.sources import policy, providers, records

Tables = dict[str, DataFrame]
COMMANDS = {}
ABSENT = {"iupacname": "needs a naming service", "conformers": "needs a force field", "download": "needs a network", "update": "needs a network", "init": "has no state to set up"}


def command(f):
    COMMANDS[f.__name__] = f
    return f


def _cell(column: str | None, names: tuple[str, ...]):
    """The named field, or the first one whose header is among the names."""
    if column:
        return F.element_at("fields", F.lit(column))
    return F.element_at("fields", F.get(F.filter(F.map_keys("fields"), lambda k: F.lower(F.trim(k)).isin(*names)), F.lit(0)))


def load(spark: SparkSession, path: str, chosen: policy.Policy | None = None, **kw) -> DataFrame:
    """Records of a file with the kernel's columns, and roles as columns of their own."""
    rows = records.read_records(spark, path, **kw)
    wide = chem.annotated(rows.drop("status"), policy=chosen)
    if chosen and chosen.repair_mode != "none":
        wide = wide.withColumn("repair", chem.diagnosis(F.when(F.col("status") == "invalid", F.col("structure")))["repair"])
    roles = dict(kw.get("roles") or {})
    for role in ("endpoint", "units", "relation", "split", "date", "source"):
        wide = wide.withColumn(role, F.nullif(F.trim(_cell(roles.get(role), records.ROLES[role])), F.lit("")))
    return checkpointed(wide)  # several tables are read from it; structures are parsed once


def measured(rows: DataFrame) -> DataFrame:
    has_units = F.col("units").isNotNull()
    with_units, without = measure.parse(F.col("endpoint"), F.col("units"), F.col("relation")), measure.parse(F.col("endpoint"), None, F.col("relation"))
    # Written, as expressions over m would otherwise be folded into many copies of the parser.
    return checkpointed(rows.withColumn("m", F.when(has_units, with_units).otherwise(without)))


@command
def audit_(spark, path, config=None, level=None, gates="{}", **kw) -> Tables:
    """All record issues, those of splits and labels where there are such columns, and the
    gates. The policy says how structures are standardised, the level, and severities."""
    p = policy.resolve(config)
    level = level or p.identity_level
    rows = load(spark, path, p, **kw)
    valid = rows.where("status = 'ok'")
    seen = rows.agg(F.count("split").alias("split"), F.count("endpoint").alias("endpoint")).collect()[0]
    more = valid.select("record_id", F.lit(None).cast("string").alias("code")).where(F.lit(False))
    if seen["split"]:
        if p.fingerprint in chem.smiles.FINGERPRINTS:
            marked, near = checkpointed(valid.withColumn("fp", chem.fingerprints(F.col("standardized"), p.fingerprint, p.fingerprint_bits))), tanimoto(F.col("fp"), F.col("ref_fp"))
        else:
            marked, near = valid, None
        more = more.unionByName(audit.split_issues(marked, level, p.similarity_threshold, near))
    if seen["endpoint"]:
        if conflicts.is_quantitative(valid, "endpoint").collect()[0]["quantitative"]:
            more = more.unionByName(audit.label_issues(measured(valid.where("endpoint is not null")), [level], "endpoint", "units", "m"))
        else:
            more = more.unionByName(audit.label_issues(valid, [level], "endpoint"))
    parts = audit.audit(rows, p.severity, level, more)
    chosen = audit.Gates(**(json.loads(gates) if isinstance(gates, str) else gates))
    parts["gates"] = audit.evaluate(chosen, rows, parts["issues"], level)
    judged = audit.clean_and_excluded(rows.select("record_id", "source_id", "structure", "status"), parts["issues"])
    return {**parts, "records": rows, "clean": judged.where(F.size("reasons") == 0), "exclusions": judged.where(F.size("reasons") > 0)}


@command
def leakage_(spark, path, **kw) -> Tables:
    rows = load(spark, path, **kw).where("status = 'ok'")
    return {"leakage": leakage.report(rows), "within": leakage.within_split_duplicates(rows.where("split is not null"), "split", "parent")}


@command
def conflicts_(spark, path, tolerance=1.0, **kw) -> Tables:
    rows = measured(load(spark, path, **kw).where("status = 'ok' and endpoint is not null"))
    return {"values": conflicts.by_value(rows, ["parent"], "m", float(tolerance)), "classes": conflicts.by_class(rows, ["parent"], "endpoint")}


@command
def cliffs_(spark, path, threshold=1.0, similarity=0.9, **kw) -> Tables:
    rows = measured(load(spark, path, **kw).where("status = 'ok' and endpoint is not null"))
    i = F.when(F.col("units").isNotNull(), measure.interval(F.col("m"), True)).otherwise(measure.interval(F.col("m"), False))
    values = cliffs.compound_values(rows.withColumn("i", i).select("nostereo", "i.lo", "i.hi"), ["nostereo"], "lo", "hi", float(threshold)).withColumnRenamed("nostereo", "id")
    compounds = values.where("not conflict").select("id", F.col("id").alias("structure"))
    pairs = cliffs.core_pairs(chem.fragments(compounds))
    judged = checkpointed(cliffs.verdicts(pairs, values, float(threshold)))
    return {"pairs": judged, "transformations": cliffs.transformations(judged), "outliers": cliffs.outliers(judged, values, float(threshold)), "summary": cliffs.summary(judged)}


@command
def split(spark, path, strategy="identity", fractions='{"train": 0.8, "test": 0.2}', seed=0, **kw) -> Tables:
    rows = load(spark, path, **kw)
    key = splits.group_key(strategy, identity="parent", scaffold="scaffold", temporal="date", source="source", structure="structure")
    rows, share = rows.withColumn("group_key", key), json.loads(fractions) if isinstance(fractions, str) else fractions
    fill = splits.ordered_fill(rows, "group_key", share) if strategy in ("temporal", "source") else splits.greedy_fill(rows, "group_key", share, int(seed))
    done = splits.assign(rows.drop("split"), "group_key", fill)
    return {"assignments": done.select("record_id", "source_id", "group_key", "split"), "sizes": splits.group_sizes(fill), "balance": splits.balance(done, "endpoint"), "leakage": leakage.report(done)}


@command
def generated(spark, path, reference=None, constraints="{}", **kw) -> Tables:
    rows = load(spark, path, **kw)
    bounds = {k: tuple(v) for k, v in json.loads(constraints).items()}
    valid = generation.validity(rows, "structure", F.col("canonical")).withColumn("passes", rules.passes(bounds, {k: F.col(k) for k in bounds}))
    fine = valid.where("reason is null")
    out = {"report": generation.report(valid, "parent"), "molecules": generation.uniqueness(fine, "parent").select("record_id", "structure", "duplicate_of", "passes"), "reasons": valid.groupBy("reason").agg(F.count("*").alias("n"))}
    if reference:
        out["novelty"] = generation.novelty(fine, load(spark, reference).where("status = 'ok'"), identity.LEVELS[:5])
    return out


@command
def standardize(spark, path, **kw) -> Tables:
    return {"standardized": records.read_records(spark, path, **kw).select("record_id", "structure", chem.standardized("structure").alias("s")).select("record_id", "structure", "s.*")}


@command
def tautomers(spark, path, **kw) -> Tables:
    rows = records.read_records(spark, path, **kw).select("record_id", "structure", chem.tautomers("structure").alias("t"))
    return {"tautomers": search.exploded(rows, "t", "tautomer")}


@command
def stereo(spark, path, **kw) -> Tables:
    return {"stereo": load(spark, path, **kw).select("record_id", "structure", "n_stereo", "n_assigned")}


@command
def identity_(spark, path, level="parent", **kw) -> Tables:
    rows = load(spark, path, **kw).where("status = 'ok'")
    found = identity.audit_groups(rows, level)
    return {"groups": found.where("size > 1"), "members": identity.members(rows, found, level), "levels": identity.distinct_per_level(rows)}


@command
def diff_(spark, path, other, level="parent", **kw) -> Tables:
    a, b = (load(spark, p, **kw).where("status = 'ok'") for p in (path, other))
    found = diff.diff_libraries(a, b, level)
    return {"entries": found, "changes": diff.change_phrases(a, b, level), "summary": diff.summary(found)}


@command
def fingerprint(spark, path, kind="ecfp4", bits=2048, **kw) -> Tables:
    return {"fingerprints": records.read_records(spark, path, **kw).select("record_id", chem.fingerprints(F.col("structure"), kind, int(bits)).alias("words"))}


@command
def similar(spark, path, query, threshold=0.0, top=None, kind="ecfp4", **kw) -> Tables:
    from assayforge.functions.smiles import FINGERPRINTS, checked, words

    mine = F.lit(words(FINGERPRINTS[kind](checked(query), 2048)))
    rows = records.read_records(spark, path, **kw).select("record_id", "position", "structure", chem.fingerprints(F.col("structure"), kind).alias("fp")).where("fp is not null")
    return {"similar": search.similar(rows, tanimoto(F.col("fp"), mine), float(threshold), int(top) if top else None).drop("fp")}


@command
def filter_(spark, path, rule="lipinski", fail=False, **kw) -> Tables:
    rows = load(spark, path, **kw).withColumn("rotatable", F.col("rotatable_bonds")).withColumn("atoms", F.col("heavy_atoms")).withColumn("mr", F.lit(None).cast("double"))
    columns = {n: F.col(n) for n, _, _ in rules.RULES[rule]}
    judged = rows.where("status = 'ok'").withColumns({"violations": rules.violations(rules.RULES[rule], columns), "unjudged": rules.unjudged(rules.RULES[rule], columns), "verdict": rules.verdict(rules.RULES[rule], columns)})
    shown = ["record_id", "structure", "violations", "unjudged"]
    # What cannot be judged neither passes nor fails.
    return {"filtered": judged.where(~F.col("verdict") if fail else F.col("verdict")).select(*shown), "unjudged": judged.where("verdict is null").select(*shown)}


@command
def substructure(spark, path, pattern, preparation="implicit-h", **kw) -> Tables:
    rows = records.read_records(spark, path, **kw).withColumn("atoms", chem.matched(F.col("structure"), pattern, preparation))
    return {"matches": search.matching(rows, F.size("atoms") > 0).select("record_id", "structure", "atoms")}


@command
def scaffold(spark, path, **kw) -> Tables:
    return {"scaffolds": load(spark, path, **kw).select("record_id", "structure", "scaffold")}


@command
def rgroup(spark, path, core, **kw) -> Tables:
    return {"groups": records.read_records(spark, path, **kw).select("record_id", "structure", chem.r_groups(F.col("structure"), core).alias("groups"))}


def _panel(spark, path, **kw) -> DataFrame:
    return records.read_records(spark, path, parse=chem.canonical, **kw).where("status = 'ok'").select(F.col("position").alias("item_id"), "structure")


def _catalogue(spark, path) -> tuple[DataFrame, list[tuple[int, str]], DataFrame]:
    from assayforge.functions.smarts import compile_

    rows = records.read_patterns(spark, path)
    good, bad = [], []
    for r in rows.collect():  # a catalogue, not data
        try:
            compile_(r["pattern"])
            good.append((int(r["pattern_id"]), r["pattern"]))
        except ValueError as e:
            bad.append((int(r["pattern_id"]), r["pattern"], str(e)))
    return rows.withColumn("pattern_id", F.col("pattern_id").cast("int")), good, spark.createDataFrame(bad, "pattern_id int, pattern string, error string")


@command
def smartsaudit(spark, path, library, preparations=("implicit-h", "explicit-h", "kekule"), **kw) -> Tables:
    rows, good, bad = _catalogue(spark, path)
    items = _panel(spark, library)
    found, made = checkpointed(chem.pattern_hits(items, good, tuple(preparations))), checkpointed(chem.evaluated(items, tuple(preparations)))
    return {
        "evidence": patterns.evidence(rows, found, made, preparations[0]), "breadth": patterns.breadth(found, made), "sensitivity": patterns.sensitivity(found, made, preparations[0]),
        "examples": patterns.examples(found), "unreadable": bad, "panel": patterns.panel(items, "structure"), "cleanup": patterns.cleanup(rows, found),
    }


@command
def smartsdiff(spark, path, other, library, preparation="implicit-h", **kw) -> Tables:
    (a, ga, _), (b, gb, _) = _catalogue(spark, path), _catalogue(spark, other)
    items = _panel(spark, library)
    ha, hb = (checkpointed(chem.pattern_hits(items, g, (preparation,))) for g in (ga, gb))
    return {"patterns": patterns.behaviour(patterns.pair_catalogues(a, b, ha, hb), ha, hb), "verdicts": patterns.verdict_changes(items, ha, hb)}


@command
def smartsproof(spark, path, **kw) -> Tables:
    rows = _catalogue(spark, path)[0]
    found = checkpointed(proof.prove_catalogue(rows))
    same = found.where("equivalent").select("pattern_id", F.col("contained_by").alias("equivalent_to"))
    none = spark.createDataFrame([], "pattern_id int, item_id long, preparation string")
    return {"containment": found, "cleanup": patterns.cleanup(rows, none, same)}


@command
def validate(spark, path, **kw) -> Tables:
    return {"validated": load(spark, path, **kw).select("record_id", "structure", "status", "canonical", F.col("formula").alias("parent_formula"), "exact_mass", "hbd", "hba", "tpsa")}


@command
def diagnose(spark, path, **kw) -> Tables:
    return {"diagnosis": records.read_records(spark, path, **kw).select("record_id", "structure", chem.diagnosis("structure").alias("d")).select("record_id", "structure", "d.*")}


@command
def reaction(spark, path, **kw) -> Tables:
    return {"reactions": records.read_records(spark, path, **kw).select("record_id", "structure", chem.reaction_counts("structure").alias("r")).select("record_id", "structure", "r.*")}


@command
def atommap(spark, path, **kw) -> Tables:
    return {"mapped": records.read_records(spark, path, **kw).select("record_id", "structure", chem.atom_mapped("structure").alias("mapped"))}


@command
def augment(spark, path, n=5, seed=0, **kw) -> Tables:
    rows = records.read_records(spark, path, **kw).select("record_id", "structure", chem.augmented(F.col("structure"), int(n), int(seed)).alias("s"))
    return {"spellings": search.exploded(rows, "s", "spelling")}


@command
def resolve(spark, path, source="pubchem", **kw) -> Tables:
    """path: a Parquet table (query, payload) of saved answers."""
    table = spark.read.parquet(path)
    rows = providers.from_kegg(table) if source == "kegg" else providers.from_json(table, source)
    return {"answers": rows, "consensus": merge.consensus(rows, "inchikey"), "merged": merge.merged(rows, list(providers.FIELDS))}


@command
def status(spark, path="", **kw) -> Tables:
    """What the kernel leaves out."""
    return {"unsupported": spark.createDataFrame(sorted({**chem.UNSUPPORTED, **ABSENT}.items()), "feature string, reason string")}


def run(spark: SparkSession, name: str, *args, **kw) -> Tables:
    if name in ABSENT:
        raise NotImplementedError(f"{name} {ABSENT[name]}")
    f = COMMANDS.get(name) or COMMANDS.get(f"{name}_")
    if f is None:
        raise ValueError(f"unknown command {name}; known: {sorted(c.rstrip('_') for c in COMMANDS)}")
    return f(spark, *args, **kw)


def main(argv: list[str] | None = None) -> None:
    from assayforge.sinks.reports import write_table

    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command")
    p.add_argument("paths", nargs="*")
    p.add_argument("--out", required=True)
    p.add_argument("--format", default="csv", choices=["csv", "json", "parquet"])
    p.add_argument("--set", action="append", default=[], metavar="NAME=VALUE")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    options = dict(x.split("=", 1) for x in a.set)
    for name, table in run(spark, a.command, *a.paths, **options).items():
        write_table(table, f"{a.out.rstrip('/')}/{name}", a.format)


if __name__ == "__main__":
    main()
