from pyspark.sql import functions as F

from assayforge.operators import audit, identity
from assayforge.streaming import ingest


def test_files_as_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,smiles\n1,CCO\n2,\n")
    (tmp_path / "in" / "b.csv").write_text("id,smiles\n3,C C\n1,CCO\n")
    stream = ingest.record_stream(spark, f"file://{tmp_path}/in", ["id", "smiles"], "smiles", files_per_batch=1)
    seen = []
    query = ingest.each_batch(stream, lambda df, n: seen.extend(identity.accounting(df).collect()), f"file://{tmp_path}/ck1")
    query.awaitTermination(120)
    total = {}
    for r in seen:
        total[r["status"]] = total.get(r["status"], 0) + r["n"]
    assert total == {"ok": 2, "empty": 1, "invalid": 1}
    rows = []
    query = ingest.each_batch(ingest.first_seen(stream.where("status = 'ok'"), "id"), lambda df, n: rows.extend(df.collect()), f"file://{tmp_path}/ck2")
    query.awaitTermination(120)
    assert [r["id"] for r in rows] == ["1"]


def test_counts_by_window(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:05", "empty"), ("2024-01-01 00:00:50", "empty"), ("2024-01-01 00:02:00", "ok")], "t string, status string").withColumn("arrived", F.to_timestamp("t"))
    found = ingest.issue_counts(rows, {"PARSE_EMPTY": F.col("status") == "empty"}).collect()
    assert [(r["code"], r["n"]) for r in found] == [("PARSE_EMPTY", 2)]
    assert audit.catalogue({"PARSE_EMPTY": "ignore"}).get("PARSE_EMPTY") is None
