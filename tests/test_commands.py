import pytest

from assayforge.plans import commands

TABLE = """id,smiles,value,units,relation,split,date,source
1,CCO,10,nM,=,train,2020-01-01,a
2,OCC,5000,nM,=,test,2019-01-01,b
3,CCN,20,nM,=,train,2020-02-01,a
4,c1ccccc1CCN,30,nM,<,train,2020-03-01,a
5,c1ccccc1CCO,9000,nM,=,test,2021-01-01,b
6,,1,nM,=,test,2021-01-01,b
7,C1CC,1,nM,=,train,2021-01-01,b
8,CC(=O)[O-].[Na+],7,nM,=,train,2021-01-01,c
9,CC(=O)O,8,nM,=,test,2021-01-01,c
"""


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    f = tmp_path_factory.mktemp("commands") / "t.csv"
    f.write_text(TABLE)
    return f"file://{f}"


@pytest.fixture(scope="module")
def alerts(tmp_path_factory):
    f = tmp_path_factory.mktemp("commands") / "p.csv"
    f.write_text("name,smarts\nalcohol,[OX2H]\namine,[NX3]\nalcohol again,[OX2H]\nhydrogen,[#1]\nbad,[C\n")
    return f"file://{f}"


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_dataset_commands(spark, path):
    found = commands.run(spark, "audit", path)
    assert {r["status"]: r["n"] for r in rows(found["accounting"])} == {"ok": 7, "empty": 1, "invalid": 1}
    assert found["clean"].count() + found["exclusions"].count() == 9
    leak = {r["level"]: r["n_eval_records"] for r in rows(commands.run(spark, "leakage", path)["leakage"])}
    assert leak["exact"] == 1 and leak["parent"] == 2
    conflict = [r for r in rows(commands.run(spark, "conflicts", path)["values"]) if r["conflict"]]
    assert len(conflict) == 1 and conflict[0]["scale"] == "log10 molar" and abs(conflict[0]["spread"] - 2.699) < 0.001
    done = commands.run(spark, "cliffs", path)
    assert rows(done["summary"])[0]["n_pairs"] >= 1
    parts = commands.run(spark, "split", path, fractions={"train": 0.5, "test": 0.5})
    keys = {}
    for r in rows(parts["assignments"]):
        keys.setdefault(r["group_key"], set()).add(r["split"])
    assert all(len(v) == 1 for v in keys.values())
    gen = commands.run(spark, "generated", path, reference=path)
    assert rows(gen["report"])[0] == {"n": 9, "n_valid": 7, "n_unique": 5} and all(r["n_novel"] == 0 for r in rows(gen["novelty"]))


def test_structure_commands(spark, path):
    assert {r["status"] for r in rows(commands.run(spark, "validate", path)["validated"])} == {"ok", "empty", "invalid"}
    assert rows(commands.run(spark, "identity", path)["levels"])[0]["n_parent"] == 5
    assert {r["status"] for r in rows(commands.run(spark, "diff", path, path)["entries"])} == {"unchanged"}
    top = rows(commands.run(spark, "similar", path, "CCO", threshold=0.9)["similar"])
    assert [r["record_id"] for r in sorted(top, key=lambda r: r["rank"])] == ["r000000", "r000001"]
    assert len(rows(commands.run(spark, "substructure", path, "[OX2H]")["matches"])) == 4
    assert commands.run(spark, "filter", path, fail=True)["filtered"].count() == 0  # none can be judged without logp
    for name, extra in (("standardize", ()), ("tautomers", ()), ("stereo", ()), ("fingerprint", ()), ("scaffold", ()), ("rgroup", ("CO",)), ("diagnose", ()), ("reaction", ()), ("atommap", ()), ("augment", ()), ("status", ())):
        for t in commands.run(spark, name, path, *extra).values():
            assert t.count() > 0
    for bad in (NotImplementedError, ValueError):
        with pytest.raises(bad):
            commands.run(spark, "conformers" if bad is NotImplementedError else "nothing", path)


def test_pattern_commands(spark, path, alerts, tmp_path):
    found = commands.run(spark, "smartsaudit", alerts, path)
    labels = {r["pattern_id"]: r["labels"] for r in rows(found["evidence"])}
    assert "exact_duplicate" in labels[2] and "needs_preparation" in labels[3] and found["unreadable"].count() == 1
    assert {r["behaviour"] for r in rows(commands.run(spark, "smartsdiff", alerts, alerts, path)["patterns"])} == {"same"}
    clean = {r["pattern_id"]: r["action"] for r in rows(commands.run(spark, "smartsproof", alerts)["cleanup"])}
    assert clean[2] == "remove" and clean[0] == "keep"
    commands.main(["validate", path, "--out", f"file://{tmp_path}/out"])
    assert spark.read.csv(f"file://{tmp_path}/out/validated", header=True).count() == 9


def issues(found):
    return {(r["record_id"], r["code"]) for r in rows(found["issues"])}


def test_audit_finds_splits_labels_and_repairs(spark, path):
    found = issues(commands.run(spark, "audit", path))
    assert {("r000001", "SPLIT_OVERLAP"), ("r000008", "SPLIT_OVERLAP"), ("r000000", "LABEL_CONFLICT"), ("r000001", "LABEL_CONFLICT")} <= found
    assert {("r000004", "SPLIT_RELATED"), ("r000001", "TEMPORAL_ORDER"), ("r000007", "STD_CHANGED_IDENTITY"), ("r000006", "REPAIR_CANDIDATE")} <= found
    assert ("r000003", "RELATION_CENSORED") not in found  # alone in its group


@pytest.mark.parametrize(
    "gate,code",
    [({"fail_on": "error"}, 3), ({"most_invalid": 0.1}, 3), ({"most_invalid": 0.5}, 0), ({"most_duplicates": 0.1}, 3), ({"most_duplicates": 0.9}, 0), ({"no_overlap": True}, 3), ({"no_conflicts": True}, 3), ({"complete": True}, 0)],
)
def test_gates_of_an_audit(spark, path, gate, code):
    assert rows(commands.run(spark, "audit", path, gates=gate)["gates"])[0]["exit_code"] == code


def test_gates_hold_on_a_clean_table(spark, tmp_path):
    f = tmp_path / "clean.csv"
    f.write_text("id,smiles,split\n1,CCCCO,train\n2,c1ccccc1CCN,train\n3,CC(=O)NC1CCOCC1,test\n")
    found = commands.run(spark, "audit", f"file://{f}", gates={"fail_on": "error", "most_invalid": 0.0, "most_duplicates": 0.0, "no_overlap": True, "no_conflicts": True, "complete": True})
    assert rows(found["gates"])[0]["exit_code"] == 0


def test_a_failed_standardisation_is_named(spark, tmp_path, monkeypatch):
    from assayforge.operators import audit

    df = spark.createDataFrame([(0, "ok", "fragment: no"), (1, "ok", None)], "record_id long, status string, std_error string")
    found = audit.with_severity(audit.annotate(df, {"STD_FAILED": audit.record_conditions()["STD_FAILED"]}))
    assert [(r["record_id"], r["code"]) for r in found.collect()] == [(0, "STD_FAILED")]
    one = audit.evaluate(audit.Gates(complete=True), df.withColumn("parent", df["record_id"]), found).collect()[0]
    assert one["exit_code"] == 4 and one["partial"]


def test_policies_give_other_groups(spark, path):
    a, b = (commands.run(spark, "audit", path, config=c) for c in ("parent", "conservative"))
    size = lambda found: sorted(r["size"] for r in rows(found["groups"]))
    assert size(a) != size(b) and ("r000008", "SPLIT_OVERLAP") not in issues(b)
    made = lambda found: {r["record_id"]: r["standardized"] for r in rows(found["records"])}
    assert "Na" in made(b)["r000007"] and "Na" not in made(a)["r000007"]
    assert ("r000006", "REPAIR_CANDIDATE") not in issues(b)


def test_rules_that_cannot_be_judged(spark, path):
    found = commands.run(spark, "filter", path, rule="lipinski")
    assert rows(found["filtered"]) == [] and {tuple(r["unjudged"]) for r in rows(found["unjudged"])} == {("logp",)}
    assert len(rows(commands.run(spark, "filter", path, rule="veber")["filtered"])) == 7
