"""Measurements as text: parsing, units, intervals, gaps and verdicts.

All are expressions over columns. ANSI mode raises on bad casts, so every number
from text goes through try_cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of ten of the SI prefixes that molar units come with, the micro sign in both its forms.
PREFIXES = {"p": -12, "n": -9, "u": -6, "\u00b5": -6, "\u03bc": -6, "m": -3, "": 0}
MOLAR_TO_NM = {f"{prefix}m": 10.0 ** (power - PREFIXES["n"]) for prefix, power in PREFIXES.items()}
#: Relations that can stand before a number.
RELATIONS = ("<", "<=", "=", ">", ">=", "~")
#: A measurement is a relation, if any, a number, and the upper end if it is a range.
_RELATION = "|".join(sorted(RELATIONS, key=len, reverse=True))
_NUMBER = r"[+-]?(?:\d*\.\d+|\d+)(?:[eE][+-]?\d+)?"
PATTERN = rf"^\s*({_RELATION})?\s*({_NUMBER})(?:\s*-\s*({_NUMBER}))?\s*$"


def _group(c: Column, n: int) -> Column:
    return F.nullif(F.regexp_extract(c, PATTERN, n), F.lit(""))


def is_measurement(c: Column) -> Column:
    return c.rlike(PATTERN)


def parse(raw: Column, units: Column | None = None, relation: Column | None = None) -> Column:
    """struct(relation, value, upper, units, value_nm, log_value, censored, comparable).

    A relation of its own column goes before one inside the text; a range goes
    before both. Without a units column the value is a number on its own scale;
    with one, a value without units cannot be compared.
    """
    raw = F.trim(F.coalesce(raw.cast("string"), F.lit("")))
    own = F.nullif(F.trim(relation), F.lit("")) if relation is not None else F.lit(None).cast("string")
    value, upper = _group(raw, 2).try_cast("double"), _group(raw, 3).try_cast("double")
    rel = F.coalesce(own, _group(raw, 1), F.lit("="))
    rel = F.when(rel == "'='", "=").otherwise(rel)
    rel = F.when(value.isNull(), None).when(upper.isNotNull(), "range").otherwise(rel)
    unit = F.nullif(F.trim(units), F.lit("")) if units is not None else F.lit(None).cast("string")
    factor = F.element_at(F.create_map(*[F.lit(x) for kv in MOLAR_TO_NM.items() for x in kv]), F.lower(unit))
    factor = F.when(unit.isNotNull(), factor)
    nm = value * factor
    log = F.when(nm > 0, F.bround(-F.log10(nm * 1e-9), 4))
    return F.struct(
        rel.alias("relation"), value.alias("value"), upper.alias("upper"), unit.alias("units"), nm.alias("value_nm"), log.alias("log_value"),
        F.coalesce(rel != "=", F.lit(False)).alias("censored"),
        (value.isNotNull() & (F.lit(units is None) | unit.isNotNull())).alias("comparable"),
    )


def interval(m: Column, molar: bool) -> Column:
    """struct(lo, hi, usable): what a measurement says; a missing end is open.

    On the molar scale numbers are negative logarithms, so an upper bound of
    concentration is a lower bound there, and ``~`` counts as a point.
    """
    none = F.lit(None).cast("double")
    rel, v, up = m["relation"], m["value"], m["upper"]
    if molar:
        p = F.when(m["value_nm"] > 0, -F.log10(m["value_nm"] * 1e-9))
        q = F.when((up > 0) & (v != 0), -F.log10(up * m["value_nm"] / v * 1e-9))
        lower, higher, a, b = rel.isin(">", ">="), rel.isin("<", "<="), p, q
    else:
        lower, higher, a, b = rel.isin("<", "<="), rel.isin(">", ">="), v, up
    point, both = rel.isin("=", "~"), (rel == "range") & b.isNotNull()
    lo = F.when(point | higher, a).when(both, F.least(a, b)).otherwise(none)
    hi = F.when(point | lower, a).when(both, F.greatest(a, b)).otherwise(none)
    usable = F.coalesce(m["comparable"] & a.isNotNull() & (point | lower | higher | both), F.lit(False))
    return F.struct(F.when(usable, lo).alias("lo"), F.when(usable, hi).alias("hi"), usable.alias("usable"))


def gap(alo: Column, ahi: Column, blo: Column, bhi: Column) -> Column:
    """struct(least, most): least proven and most compatible difference, null if unbounded."""
    least = F.greatest(F.lit(0.0), alo - bhi, blo - ahi)
    most = F.when(alo.isNotNull() & ahi.isNotNull() & blo.isNotNull() & bhi.isNotNull(), F.greatest(ahi - blo, bhi - alo))
    return F.struct(least.alias("least"), most.alias("most"))


def verdict(g: Column, threshold: float) -> Column:
    return F.when(g["least"] >= threshold, "cliff").when(g["most"] < threshold, "consistent").otherwise("undetermined")
