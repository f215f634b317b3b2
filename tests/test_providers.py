import json

from assayforge.functions.registry import register
from assayforge.operators import merge
from assayforge.sources import providers

KEY, SMILES = "RYYVLZVUVIJVGH-UHFFFAOYSA-N", "CN1C=NC2=C1C(=O)N(C)C(=O)N2C"
PUBCHEM = {"PropertyTable": {"Properties": [{"CID": 2519, "Title": "Caffeine", "IsomericSMILES": SMILES, "InChIKey": KEY, "MolecularFormula": "C8H10N4O2", "MolecularWeight": "194.19", "Charge": 0}]}}
CHEMBL = {"molecule_chembl_id": "CHEMBL113", "pref_name": "CAFFEINE", "molecule_structures": {"canonical_smiles": SMILES, "standard_inchi_key": KEY}, "molecule_properties": {"full_molformula": "C8H10N4O2", "alogp": "-1.03"}}
KEGG = "\n".join(
    f"{name:<12}{text}"
    for name, text in (("ENTRY", "C07481                      Compound"), ("NAME", "Caffeine (JP18/USP);"), ("", "1,3,7-Trimethylxanthine"), ("FORMULA", "C8H10N4O2"), ("EXACT_MASS", "194.0804"), ("MOL_WEIGHT", "194.1906"), ("///", ""), ("NAME", "another entry"))
).replace("///         ", "///")


def payloads(spark, *rows):
    return spark.createDataFrame([(q, p if isinstance(p, str) else json.dumps(p)) for q, p in rows], "query string, payload string")


def test_payloads_to_one_answer(spark):
    a = providers.from_json(payloads(spark, ("caffeine", PUBCHEM), ("nothing", {"Fault": {}})), "pubchem")
    b = providers.from_json(payloads(spark, ("caffeine", CHEMBL)), "chembl")
    c = providers.from_kegg(payloads(spark, ("caffeine", KEGG)))
    rows = a.unionByName(b).unionByName(c)
    got = {r["source"]: r for r in rows.collect()}
    assert set(got) == {"pubchem", "chembl", "kegg"} and got["kegg"]["name"] == "Caffeine" and got["kegg"]["molecular_weight"] == 194.1906
    assert got["kegg"]["synonyms"] == ["Caffeine", "1,3,7-Trimethylxanthine"] and got["chembl"]["xlogp"] == -1.03
    best = merge.consensus(rows, "inchikey").collect()
    assert [(r["inchikey"], r["n_sources"]) for r in best] == [(KEY, 2)]
    one = merge.merged(rows, ["name", "formula", "smiles"]).collect()[0]
    assert (one["name"], one["name_source"], one["formula"]) == ("Caffeine", "pubchem", "C8H10N4O2")
    sources = spark.createDataFrame([("pubchem", 0), ("chembl", 1), ("kegg", 3)], "source string, priority int")
    fix = merge.corrections(rows, merge.consensus(rows, "inchikey"), "inchikey", rows.select("source", "inchikey"), sources).collect()
    assert [(r["source"], r["kind"], r["found"]) for r in fix] == [("kegg", "missing", False)]


def test_cross_references_and_hits(spark):
    lists = payloads(spark, ("k", json.dumps([{"src_id": "1", "src_compound_id": "A"}, {"src_id": "1", "src_compound_id": "B"}, {"src_id": "9", "src_compound_id": "C"}])), ("e", json.dumps({"error": "x"})))
    names = spark.createDataFrame([("1", "chembl")], "src_id string, database string")
    assert {(r["database"], r["id"]) for r in providers.unichem_references(lists, names).collect()} == {("chembl", "A"), ("unichem_src_9", "C")}
    hits = spark.createDataFrame([("q", "other", ["Q"], 1, 0, "s0"), ("q", "more", [], 3, 1, "s1"), ("z", "n", [], 2, 0, "t0"), ("z", "n", [], 3, 1, "t1")], "query string, name string, synonyms array<string>, stars int, position int, source_id string")
    assert {r["query"]: r["source_id"] for r in providers.best_hit(hits).collect()} == {"q": "s0", "z": "t1"}


def test_sql_functions(spark):
    register(spark)
    r = spark.sql("select canonical_structure('OCC') c, identity_key('CC(=O)[O-].[Na+]', 'formula') f, molecular_formula('C1') m, matches_pattern('CCO', '[OX2H]') p, standard_structure('[Na+].CC(=O)[O-]') s").collect()[0]
    assert r["c"] == "CCO" and r["f"] == "C2H4O2" and r["m"] is None and r["p"] is True and r["s"] == "CC(=O)O"
