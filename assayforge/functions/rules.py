"""Rule filters and constraints over descriptor columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The usual drug-likeness rules as (descriptor, least, most).
RULES: dict[str, list[tuple[str, float | None, float | None]]] = {
    "lipinski": [("mw", None, 500), ("logp", None, 5), ("hbd", None, 5), ("hba", None, 10)],
    "veber": [("rotatable", None, 10), ("tpsa", None, 140)],
    "ghose": [("mw", 160, 480), ("logp", -0.4, 5.6), ("mr", 40, 130), ("atoms", 20, 70)],
    "egan": [("tpsa", None, 131.6), ("logp", None, 5.88)],
    "ro3": [("mw", None, 300), ("logp", None, 3), ("hbd", None, 3), ("hba", None, 3), ("rotatable", None, 3)],
}


def violations(rule: list[tuple[str, float | None, float | None]], columns: dict[str, Column]) -> Column:
    """Texts of what a row violates; a descriptor that is missing violates nothing."""
    found = []
    for name, least, most in rule:
        c = columns[name]
        if least is not None:
            found.append(F.when(c < least, F.lit(f"{name} < {least:g}")))
        if most is not None:
            found.append(F.when(c > most, F.lit(f"{name} > {most:g}")))
    return F.array_compact(F.array(*found))


def unjudged(rule: list[tuple[str, float | None, float | None]], columns: dict[str, Column]) -> Column:
    """Names of the descriptors that a row lacks."""
    return F.array_compact(F.array(*(F.when(columns[name].isNull(), F.lit(name)) for name, _, _ in rule)))


def verdict(rule: list[tuple[str, float | None, float | None]], columns: dict[str, Column]) -> Column:
    """False where something is violated, else true, or null where a descriptor is missing:
    then the rule cannot be judged."""
    return F.when(F.size(violations(rule, columns)) > 0, False).when(F.size(unjudged(rule, columns)) == 0, True)


def passes(constraints: dict[str, tuple[float | None, float | None]], columns: dict[str, Column]) -> Column:
    """Whether all constraints hold, ends included; a missing value fails."""
    ok = F.lit(True)
    for name, (least, most) in constraints.items():
        c = columns[name]
        ok = ok & c.isNotNull()
        if least is not None:
            ok = ok & (c >= least)
        if most is not None:
            ok = ok & (c <= most)
    return F.coalesce(ok, F.lit(False))
