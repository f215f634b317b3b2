import pytest

from assayforge.functions import chem, smarts, smiles, standardize
from assayforge.functions.diagnose import diagnose

SAME = [
    ("c1ccccc1O", "OC1=CC=CC=C1"), ("CC(=O)O", "OC(C)=O"), ("c1ccc2[nH]ccc2c1", "C1=CC2=C(C=C1)NC=C2"), ("Cn1cnc2c1c(=O)n(C)c(=O)n2C", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C"),
    ("N[C@@H](C)C(=O)O", "C[C@H](N)C(=O)O"), ("F/C=C/F", "F\\C=C\\F"), ("[O-]C(=O)c1ccccc1.[Na+]", "[Na+].O=C([O-])c1ccccc1"), ("C1CCCCC1", "C%12CCCCC%12"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_spellings_of_one_compound(a, b):
    assert smiles.identity(smiles.parse(a)) == smiles.identity(smiles.parse(b))


@pytest.mark.parametrize("text", [a for a, _ in SAME] + ["CC(=O)Oc1ccccc1C(=O)O", "C[N+](C)(C)CC([O-])=O", "O=S(=O)(N)c1ccc(cc1)Cl", "c1ccc2cc3ccccc3cc2c1"])
def test_writing_is_stable(text):
    mol = smiles.parse(text)
    once = smiles.write(mol)
    assert smiles.write(smiles.parse(once)) == once
    assert {smiles.write(smiles.parse(s)) for s in smiles.spellings(text, 8)} == {once}


def test_levels_nest():
    pairs = {"parent": ("CC(=O)O", "CC(=O)[O-].[Na+]"), "tautomer": ("CC(=O)C", "CC(O)=C"), "nostereo": ("C[C@H](N)C(=O)O", "C[C@@H](N)C(=O)O"), "formula": ("CCO", "COC")}
    for level, (a, b) in pairs.items():
        x, y = (smiles.identity(smiles.parse(s)) for s in (a, b))
        assert x["exact"] != y["exact"] and x[level] == y[level] and x["formula"] == y["formula"]
        if level in ("tautomer", "nostereo"):
            assert x["parent"] != y["parent"] and x["skeleton"] == y["skeleton"]


def test_descriptors():
    d = smiles.descriptors(smiles.parse("CC(=O)Oc1ccccc1C(=O)O"))
    assert (d["mw"], d["hbd"], d["heavy_atoms"], d["rings"], d["tpsa"]) == (180.159, 1, 13, 1, 63.6)
    assert round(smiles.mass(smiles.parse("CC(=O)Oc1ccccc1C(=O)O"), smiles.EXACT), 4) == 180.0423
    assert smiles.formula(smiles.parse("CC(=O)Oc1ccccc1C(=O)O")) == "C9H8O4"
    assert smiles.scaffold(smiles.parse("CC(=O)Oc1ccccc1C(=O)O")) == smiles.write(smiles.parse("c1ccccc1"))
    assert smiles.scaffold(smiles.parse("CCO")) == "acyclic"


@pytest.mark.parametrize("text,category", [("C1CC", "rings"), ("C(C", "parentheses"), ("CC)C", "parentheses"), ("CN(C)(C)(C)C", "valence"), ("c1cccc1", "aromaticity"), ("C C", "characters"), ("C[Xx]", "brackets"), ("C–C", "characters")])
def test_diagnosis(text, category):
    found = diagnose(text)
    assert found["status"] == "invalid" and found["problems"][0][0] == category
    assert all(smiles.parse(c) is not None for _, c in found["repairs"])


def test_empty_is_not_invalid():
    assert {diagnose(t)["status"] for t in (None, "", "  ", "nan")} == {"empty"} and diagnose("CCO")["status"] == "ok"


@pytest.mark.parametrize("pattern,text,n", [("[OX2H]", "CCO", 1), ("c1ccccc1", "Cc1ccccc1", 1), ("[#6]=[O,S]", "CC(=O)CC=S", 2), ("[NX3;H2;!$(NC=O)]", "NCC(=O)N", 1), ("[R]", "C1CC1C", 3), ("C~N", "C#N", 1), ("[CH3]", "CCO", 1), ("[n+]", "C[n+]1ccccc1", 1), ("[D3]", "CC(C)C", 1), ("C-C", "C=C", 0)])
def test_patterns(pattern, text, n):
    assert len(smarts.matches(smiles.parse(text), pattern)) == n


def test_preparations_change_hits():
    mol = smiles.parse("CCO")
    assert smarts.match(mol, "[#1]") is None and smarts.match(smarts.with_hydrogens(mol), "[#1]") is not None
    assert smarts.match(smiles.parse("c1ccccc1"), "C=C") is None and smarts.match(smarts.kekule_form(smiles.parse("c1ccccc1")), "C=C") is not None
    with pytest.raises(ValueError):
        smarts.compile_("[C@H](N)O")


def test_standardize_and_tautomers():
    s = standardize.standardize("CC(=O)[O-].[Na+]")
    assert s["result"] == smiles.write(smiles.parse("CC(=O)O")) and [x[0] for x in s["steps"]] == ["fragment", "neutralize"]
    assert standardize.standardize(s["result"])["result"] == s["result"]
    assert set(standardize.tautomers(smiles.parse("CC(C)=O"))) == {smiles.write(smiles.parse(x)) for x in ("CC(C)=O", "CC(O)=C")}
    assert standardize.standardize("C1C")["status"] == "invalid"


def test_standard_tautomer_of_many(monkeypatch):
    # 126 tautomers.
    forms = ("CC(=O)CC(=O)CC(=O)CC(=O)CC(=O)C", "C=C(C=C(C=C(C=C(C=C(C)O)O)O)O)O", "CC(C=C(CC(CC(CC(C)=O)=O)=O)O)=O")
    found = [standardize.standardize(f, ("tautomer",)) for f in forms]
    assert {(s["status"], s["result"]) for s in found} == {("ok", smiles.write(smiles.parse(forms[0])))}
    monkeypatch.setattr(standardize, "TAUTOMERS", 20)
    found = standardize.standardize(forms[1], ("tautomer",))
    assert found["status"] == "error" and "20 tautomers" in found["error"]


def test_over_columns(spark):
    rows = [(0, "CCO"), (1, None), (2, "C C"), (3, "C1CC"), (4, "OCC"), (5, "CC(=O)[O-].[Na+]")]
    df = spark.createDataFrame(rows, "record_id long, structure string")
    got = {r["record_id"]: r for r in chem.annotated(df).collect()}
    assert [got[i]["status"] for i in range(6)] == ["ok", "empty", "invalid", "invalid", "ok", "ok"]
    assert got[0]["exact"] == got[4]["exact"] and got[5]["n_fragments"] == 2 and got[3]["mw"] is None
    hits = chem.pattern_hits(df.select(df["record_id"].alias("item_id"), "structure"), [(0, "[OX2H]"), (1, "[#1]")], ("implicit-h", "explicit-h"))
    assert {(r["pattern_id"], r["item_id"], r["preparation"]) for r in hits.collect()} >= {(0, 0, "implicit-h"), (1, 0, "explicit-h")}
    one = df.select(chem.matched(df["structure"], "CO").alias("m"), chem.fingerprints(df["structure"]).alias("f"), chem.r_groups(df["structure"], "CO").alias("r"), chem.standardized("structure").alias("s"), chem.diagnosis("structure").alias("d")).collect()
    assert list(one[0]["m"]) and one[1]["m"] is None and len(one[0]["f"]) == 32 and one[3]["f"] is None and one[0]["r"]["core"] and one[2]["d"]["status"] == "invalid"
    cuts = chem.fragments(df.select(df["record_id"].alias("id"), "structure")).where("id = 0").collect()
    assert any(r["rest"] == "[H][*:1]" for r in cuts)
    assert smiles.reaction_counts("CC.O>>CCO") == (2, 0, 1)


def test_explained_patterns(spark):
    items = spark.createDataFrame(list(enumerate(["CCO", "c1ccccc1", "bad(", "CCN"])), "item_id long, structure string")
    got = {(r["preparation"], r["atom"]): (r["n_hits"], r["n_pattern"], r["verdict"]) for r in chem.explain(items, "[#1]O").collect()}
    assert got["implicit-h", 0] == (0, 0, "atom") and got["implicit-h", 1] == (1, 0, "combination") and got["explicit-h", 0] == (3, 1, "fires")
    assert {(r["element"], r["n"]) for r in chem.panel_elements(items).collect()} == {("C", 3), ("N", 1), ("O", 1)}
    assert chem.evaluated(items, ("implicit-h", "kekule")).count() == 6
    assert chem.spaced(items, 4, 2).count() == 2
