"""The kernel's functions under names that SQL text can use."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assayforge.functions import smarts, smiles, standardize


def _canonical(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if (m := smiles.parse(x)) is None else smiles.write(m))


def _key(s: pd.Series, level: pd.Series) -> pd.Series:
    return pd.Series([None if (m := smiles.parse(x)) is None else str(smiles.identity(m)[k]) for x, k in zip(s, level, strict=True)])


def _formula(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if (m := smiles.parse(x)) is None else smiles.formula(m))


def _scaffold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if (m := smiles.parse(x)) is None else smiles.scaffold(m))


def _matches(s: pd.Series, pattern: pd.Series) -> pd.Series:
    return pd.Series([None if (m := smiles.parse(x)) is None else smarts.match(m, p) is not None for x, p in zip(s, pattern, strict=True)], dtype=object)


def _standard(s: pd.Series) -> pd.Series:
    return s.map(lambda x: standardize.standardize(x or "")["result"])


FUNCTIONS = {
    "canonical_structure": (_canonical, "string"), "identity_key": (_key, "string"), "molecular_formula": (_formula, "string"),
    "scaffold_of": (_scaffold, "string"), "matches_pattern": (_matches, "boolean"), "standard_structure": (_standard, "string"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to ``spark.sql``; returns their names."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(name, F.pandas_udf(f, kind))
    return list(FUNCTIONS)
