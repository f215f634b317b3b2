"""Column expressions over record text: headers, structure fields, ids, hashes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's strip() takes off, which Spark's trim() does not.
SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"


def header(name: str) -> str:
    """A header in its normal form."""
    return re.sub(r"\s+", "_", name.replace("\ufeff", "").strip().lower())


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def is_empty_structure(c: Column) -> Column:
    """Null, blank or the text "nan"."""
    return F.coalesce(strip(c), F.lit("")).isin("") | (F.lower(strip(c)) == "nan")


def has_inner_space(c: Column) -> Column:
    """White space inside a structure that is not an extended notation (a suffix in bars)."""
    return strip(c).rlike(SPACE) & ~strip(c).rlike(r"^\S+ \|.*\|$")


def structure_token(c: Column) -> Column:
    return F.regexp_extract(strip(c), r"^(\S+)", 1)


def structure_name(c: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(strip(c), r"^\S+\s+(.*)$", 1)), F.lit(""))


def query_type(c: Column) -> Column:
    """What a query string looks like."""
    s = strip(c)
    return (
        F.when(s.rlike(r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"), "inchikey")
        .when(s.rlike(r"^InChI="), "inchi")
        .when(s.rlike(r"^(?i)chebi:\d+$"), "chebi")
        .when(s.rlike(r"^(?i)chembl\d+$"), "chembl")
        .when(s.rlike(r"^(?i)(cpd:)?c\d{5}$"), "kegg")
        .when(s.rlike(r"^\d+$"), "cid")
        .otherwise("name")
    )


def cache_key(c: Column) -> Column:
    """Key of a looked-up query: its type and its text without case."""
    return F.concat(query_type(c), F.lit(":"), F.lower(strip(c)))


def nibble_hex(bits: Column) -> Column:
    """A string of at most 64 zeros and ones as hex, filled up on the left to whole digits."""
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0")).substr(17 - F.ceil(F.length(bits) / 4).cast("int"), F.lit(16))


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)
