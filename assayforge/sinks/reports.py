"""Tables, JSON, HTML and a manifest from the parts of an audit.

Tables are written by Spark as folders; only counts, and at most ``MOST_ROWS``
rows for the HTML page, come to the driver.
"""

from __future__ import annotations

import hashlib
import html
import json
import platform

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

MOST_ROWS = 500


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, arrays of text joined by ;."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, ArrayType) and f.dataType.elementType.simpleString() == "string":
            c = F.array_join(c, ";")
        elif isinstance(f.dataType, (ArrayType, MapType, StructType)):
            c = F.to_json(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def records_table(records: DataFrame, originals: list[str], added: list[str]) -> DataFrame:
    """Input cells under in:<name>, then what the audit added."""
    return flat(records.select("record_id", *(F.col("fields")[c].alias(f"in:{c}") for c in originals), *added))


def issues_table(issues: DataFrame) -> DataFrame:
    """Worst first, then by code and record."""
    rank = F.when(F.col("severity") == "error", 0).when(F.col("severity") == "warning", 1).otherwise(2)
    return flat(issues).orderBy(rank, "code", "record_id")


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """csv, json, parquet, or xlsx where openpyxl is there (then one small file by the driver)."""
    if fmt == "xlsx":
        try:
            import openpyxl  # noqa: F401
        except ImportError as e:
            raise RuntimeError("writing worksheets needs openpyxl; write CSV instead") from e
        flat(df).toPandas().to_excel(path, index=False)
    elif fmt == "csv":
        flat(df).write.mode("overwrite").csv(path, header=True, escape='"')
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_clean(judged: DataFrame, clean: str, excluded: str) -> None:
    """Records without reasons to one place, the others with theirs to another."""
    write_table(judged.where(F.size("reasons") == 0).drop("reasons"), clean)
    write_table(judged.where(F.size("reasons") > 0), excluded)


def summary(parts: dict[str, DataFrame]) -> dict:
    """Small tables of an audit as plain data."""
    small = ("accounting", "rollup", "by_severity", "max_severity", "levels")
    return {k: [r.asDict(recursive=True) for r in parts[k].collect()] for k in small if k in parts}


def render_html(parts: dict[str, DataFrame], title: str, most: int = MOST_ROWS) -> str:
    """A page with the summary and the first issues; all text is escaped."""

    def table(rows: list[dict]) -> str:
        if not rows:
            return "<p>none</p>"
        cell = lambda v: html.escape(v if isinstance(v, str) else json.dumps(v, default=str))
        head = "".join(f"<th>{html.escape(k)}</th>" for k in rows[0])
        return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"

    body = "".join(f"<h2>{html.escape(k)}</h2>{table(v)}" for k, v in summary(parts).items())
    if "issues" in parts:
        rows = [r.asDict(recursive=True) for r in issues_table(parts["issues"]).limit(most).collect()]
        body += f"<h2>issues (at most {most})</h2>{table(rows)}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{body}</body></html>"


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that does not depend on their order or files."""
    row = F.xxhash64(*(F.col(f"`{c}`") for c in flat(df).columns))
    one = flat(df).agg(F.count("*").alias("n"), F.bit_xor(row).alias("fold"), F.sum(F.shiftright(row, 32).cast("decimal(38,0)")).alias("total")).collect()[0]
    return hashlib.sha256(json.dumps([one["n"], one["fold"], str(one["total"])]).encode()).hexdigest()


def manifest(command: str, inputs: dict[str, DataFrame], outputs: dict[str, DataFrame], policy_hash: str | None = None, **settings) -> dict:
    """What went in and out, with digests and versions."""
    import pyspark

    return {
        "command": command, "policy_hash": policy_hash, "settings": settings, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__},
        "inputs": {k: table_digest(v) for k, v in inputs.items()}, "outputs": {k: table_digest(v) for k, v in outputs.items()},
    }
