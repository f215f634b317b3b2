"""Containment of patterns, proved from the patterns alone.

A pattern is read into atoms and bonds; each atom expression is turned into the
set of atom states that satisfy it, out of a finite grid (element, aromatic,
charge, hydrogens, neighbours, ring), and each bond expression into its set of
bond states. Pattern ``a`` contains ``b`` if a's atoms can be laid injectively on
b's so that every state that b allows at an atom or bond is one that a allows
there: then whatever b matches, a matches. That is a proof; failing to find one
within the budget is "undecided", and nothing is ever disproved by it. Recursive
expressions and chirality are "not analysable".
"""

from __future__ import annotations

from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.functions.smarts import Pattern, compile_
from assayforge.functions.smiles import Atom, Mol

#: The grid of atom states: elements that patterns name, and "any other" as the last one.
ELEMENTS = ("H", "B", "C", "N", "O", "F", "Si", "P", "S", "Cl", "Se", "Br", "I", "Fe")
CHARGES = (-2, -1, 0, 1, 2)
HYDROGENS = (0, 1, 2, 3, 4)
DEGREES = (0, 1, 2, 3, 4)
RINGS = (0, 1, 2)
BONDS = tuple(product((1, 2, 3, 1.5), (False, True)))
BUDGET = 200_000
MOST_ATOMS = 40


class _State:
    """One atom state, in the shape that atom tests ask about."""

    def __init__(self, element, aromatic, charge, h, degree, ring):
        self.mol = Mol([Atom(element, aromatic, charge=charge, h=h)] + [Atom("*") for _ in range(degree)])
        for j in range(degree):
            self.mol.add(0, j + 1, 1.5 if aromatic and j < 2 else 1)
        self.in_ring = [ring] + [0] * degree
        self.rings = [(0,) + (0,) * (size - 1) for size in (() if not ring else (6,))]
        self.ring_bonds = {(0, j + 1) for j in range(min(2, degree) if ring else 0)}


_grid: list[_State] = []


def grid() -> list[_State]:
    if not _grid:
        for e, a, c, h, d, r in product(ELEMENTS, (False, True), CHARGES, HYDROGENS, DEGREES, RINGS):
            if a and (e not in ("B", "C", "N", "O", "P", "S", "Se") or d < 2 or not r) or r and d < 2 or h + d > 6:
                continue
            _grid.append(_State(e, a, c, h, d, r))
    return _grid


class _Bond:
    """One bond state in the shape that bond tests ask about."""

    def __init__(self, order, ring):
        self.mol, self.ring_bonds = self, {(0, 1)} if ring else set()
        self.order = order

    def bond(self, i, j):
        return self.order


def analysable(text: str) -> bool:
    return "$(" not in text and "@" not in text.replace("~@", "").replace("-@", "").replace("@-", "") and "x" not in text and "v" not in text and not any(f"r{n}" in text for n in range(3, 10))


class Compiled:
    """Atom states as bit sets, bond states likewise."""

    def __init__(self, text: str):
        self.pattern: Pattern = compile_(text)
        self.atoms = [sum(1 << k for k, s in enumerate(grid()) if test(s, 0)) for test in self.pattern.atoms]
        self.bonds = {}
        for i, j, test in self.pattern.bonds:
            self.bonds[min(i, j), max(i, j)] = sum(1 << k for k, b in enumerate(BONDS) if test(_Bond(*b), 0, 1))


_compiled: dict[str, Compiled | None] = {}


def compiled(text: str) -> Compiled | None:
    if text not in _compiled:
        try:
            _compiled[text] = Compiled(text) if analysable(text) else None
        except ValueError:
            _compiled[text] = None
    return _compiled[text]


def subsumes(a: str, b: str, most_atoms: int = MOST_ATOMS, budget: int = BUDGET) -> tuple[str, tuple[int, ...] | None]:
    """Whether a matches wherever b does: (proven, witness), (undecided, None) or (not analysable, None).

    The witness gives, for each atom of a, the atom of b that it lies on.
    """
    x, y = compiled(a), compiled(b)
    if x is None or y is None:
        return "not analysable", None
    if len(x.atoms) > len(y.atoms) or len(x.atoms) > most_atoms:
        return "undecided", None
    options = [[j for j, s in enumerate(y.atoms) if s & ~t == 0 and s] for t in x.atoms]
    near: list[list[tuple[int, int]]] = [[] for _ in x.atoms]
    for (i, j), t in x.bonds.items():
        near[j].append((i, t))
    steps = 0

    def extend(chosen: list[int]):
        nonlocal steps
        k = len(chosen)
        if k == len(x.atoms):
            return tuple(chosen)
        for j in options[k]:
            steps += 1
            if steps > budget:
                return None
            if j in chosen:
                continue
            if all((s := y.bonds.get((min(chosen[i], j), max(chosen[i], j)))) is not None and s & ~t == 0 for i, t in near[k]):
                if (found := extend([*chosen, j])) is not None:
                    return found
        return None

    found = extend([])
    return ("proven", found) if found is not None else ("undecided", None)


def equivalent(a: str, b: str) -> str:
    one, two = subsumes(a, b)[0], subsumes(b, a)[0]
    if "not analysable" in (one, two):
        return "not analysable"
    return "proven" if one == two == "proven" else "undecided"


def satisfiable(text: str) -> str:
    """yes if every atom and bond has a state; no if one has none on the grid (a local check)."""
    c = compiled(text)
    if c is None:
        return "not analysable"
    return "yes" if all(c.atoms) and all(c.bonds.values()) else "no"


def prove_catalogue(catalogue: DataFrame, most_atoms: int = MOST_ATOMS, budget: int = BUDGET) -> DataFrame:
    """(pattern_id, contained_by, equivalent) for every proven containment of a catalogue.

    Candidates meet by a pre-filter on sizes in a join of the catalogue with itself;
    the search runs in Python workers, a few thousand patterns at most being its use.
    """

    @F.pandas_udf("string")
    def proven(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([subsumes(x, y, most_atoms, budget)[0] for x, y in zip(a, b, strict=True)])

    size = F.length(F.regexp_replace("pattern", r"\[[^\]]*\]|Br|Cl", "X")) - F.length(F.regexp_replace(F.regexp_replace("pattern", r"\[[^\]]*\]|Br|Cl", "X"), "[XBCNOPSFIbcnops*aA]", ""))
    rows = catalogue.select("pattern_id", "pattern", size.alias("size"))
    parts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("part")
    small = rows.select(F.col("pattern_id").alias("a"), F.col("pattern").alias("pa"), F.col("size").alias("sa"), parts)
    large = rows.select(F.col("pattern_id").alias("b"), F.col("pattern").alias("pb"), F.col("size").alias("sb"), F.pmod("pattern_id", F.lit(16)).cast("int").alias("part"))
    met = small.join(large, "part").where("a != b and sa <= sb")
    found = met.withColumn("verdict", proven("pa", "pb")).where("verdict = 'proven'").select("a", "b")
    back = found.select(F.col("a").alias("b"), F.col("b").alias("a"), F.lit(True).alias("both"))
    return found.join(back, ["a", "b"], "left").select(F.col("b").alias("pattern_id"), F.col("a").alias("contained_by"), F.coalesce("both", F.lit(False)).alias("equivalent"))
