import pytest

from assayforge.functions import smarts, smiles
from assayforge.operators import proof


@pytest.mark.parametrize("a,b", [("C", "CC"), ("[#6]", "c1ccccc1"), ("[#6]~[#7]", "CN"), ("[N,O]", "[OH]"), ("[NX3]", "[NX3;H2]"), ("C=O", "CC(=O)O"), ("[!#6]", "N"), ("a", "c")])
def test_proofs_with_witness(a, b):
    verdict, witness = proof.subsumes(a, b)
    assert verdict == "proven" and len(set(witness)) == len(witness) == len(smarts.compile_(a).atoms)
    mols = [smiles.parse(s) for s in ("CCO", "CC(=O)O", "c1ccccc1N", "CN", "NCC(=O)N", "C1CCNCC1", "Oc1ccncc1")]
    for m in mols:
        assert smarts.match(m, b) is None or smarts.match(m, a) is not None


@pytest.mark.parametrize("a,b", [("CC", "C"), ("c", "[#6]"), ("C=C", "CC"), ("[NX3;H2]", "[NX3]"), ("N", "O")])
def test_no_false_proofs(a, b):
    assert proof.subsumes(a, b)[0] == "undecided"


def test_other_verdicts():
    assert proof.subsumes("[$(CO)]", "CO")[0] == "not analysable"
    assert proof.equivalent("[#6;A]", "C") == "proven"
    assert proof.satisfiable("[C;N]") == "no" and proof.satisfiable("[C,N]") == "yes"


def test_catalogue(spark):
    rows = [(0, "CC"), (1, "C"), (2, "[#6;A]"), (3, "N")]
    got = {(r["pattern_id"], r["contained_by"], r["equivalent"]) for r in proof.prove_catalogue(spark.createDataFrame(rows, "pattern_id int, pattern string")).collect()}
    assert got == {(0, 1, False), (0, 2, False), (1, 2, True), (2, 1, True)}
