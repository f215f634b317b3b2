from collections import Counter

import pytest

import corpus_pipeline as cp
from assayforge.llm.common import BATCH_ROWS, DOCUMENT_COLUMNS, map_texts
from tests.conftest import SMALL
from tests.llm import cases
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_substring_dedup import brute as repeats


def test_stages_are_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "substring_dedup", "best_fit_packing"]


def test_near_duplicates_keep_one_of_each_class(spark):
    rows = cases.documents() + [(None, "without id"), (2000, None)]
    out = cp.drop_near_duplicates(spark, cases.table(spark, rows), SMALL)
    assert tuple(out.columns) == DOCUMENT_COLUMNS
    want = sorted(i for i, c in classes([r for r in rows if r[0] is not None]).items() if i == c)
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(i for i in got if i is not None) == want and got.count(None) == 1


def test_repeats_go_and_the_rest_stays(spark):
    rows = [r for r in cases.documents()]
    rows = list(dict(rows).items())
    out = cp.drop_repeats(spark, cases.table(spark, rows), SMALL)
    want = {i: t if g == 0 else kept for (i, t), (n, g, kept) in zip(sorted(rows), (brute_row for _, brute_row in sorted(repeats(rows).items())), strict=True) if n > g}
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == want and tuple(out.columns) == DOCUMENT_COLUMNS


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(1, a), (1, a), (1, b), (2, a), (None, a)]
    near = cp.drop_near_duplicates(spark, cases.table(spark, rows), SMALL)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in near.collect()) == [(0, a), (1, a), (1, b)]
    out = cp.drop_repeats(spark, cases.table(spark, [(1, a), (1, b), (3, b), (None, a)]), SMALL)
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, a), (1, a), (1, b)]


@pytest.mark.parametrize("name,stage", cp.STAGES[:2])
def test_nulls_and_clashing_columns(spark, name, stage):
    rows = [*cases.documents(), (None, "without an id"), (4000, None), (4000, None)]
    out = stage(spark, cases.table(spark, rows), SMALL)
    assert tuple(out.columns) == DOCUMENT_COLUMNS
    left = Counter((r["doc_id"], r["text"]) for r in out.collect())
    assert all(n <= Counter(rows)[x] for x, n in left.items())


@pytest.mark.parametrize("name,stage", cp.STAGES[:4])
def test_stages_of_an_empty_table(spark, name, stage):
    out = stage(spark, cases.empty(spark), SMALL)
    assert out.count() == 0 and tuple(out.columns) == DOCUMENT_COLUMNS


def test_run(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = cp.run(spark, SMALL).collect()
    ids = {r["doc_id"] for r in got}
    good = {r["doc_id"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    kept = classes([(r["doc_id"], r["text"]) for r in docs.where("text is not null").collect()])
    # Clean documents that are the first of their class stay, but for what repeats earlier text.
    first = {i for i, c in kept.items() if i == c} & good
    assert len(first & ids) >= 0.97 * len(first)
    assert ids <= {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_quality_stage_keeps_what_the_classifier_predicts(spark, monkeypatch):
    found = [(i, x / 100) for i, x in enumerate((0, 49, 50, 60, 69, 70, 71, 100))]
    docs = cases.table(spark, [(i, "text") for i, _ in found])
    scores = spark.createDataFrame(found, "doc_id long, score double")
    monkeypatch.setattr(cp.quality, "train", lambda docs, labels: None)
    monkeypatch.setattr(cp.quality, "annotate", lambda docs, model: docs.join(scores, "doc_id"))
    got = {r["doc_id"] for r in cp.classify_quality(spark, docs, SMALL).collect()}
    assert got == {r["doc_id"] for r in scores.where(f"score >= {cp.quality.GOOD}").collect()} == {5, 6, 7}


def test_few_rows_are_few_files(spark):
    docs = cases.table(spark).repartition(64)
    few = 4 * spark.sparkContext.defaultParallelism
    for stage in (cp.identify_language, cp.classify_quality):
        assert stage(spark, docs, SMALL).rdd.getNumPartitions() <= few


def test_batches_of_whole_texts_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for given, held in (("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("500", 500)):
            spark.conf.set(key, given)
            cp.identify_language(spark, cases.table(spark), SMALL)
            assert int(spark.conf.get(key)) == held
        spark.conf.set(key, "10000")
        rows = map_texts(spark.range(0, 4500, 1, 1), _sizes, "n long").collect()
        assert sum(r["n"] for r in rows) == 4500 and max(r["n"] for r in rows) == BATCH_ROWS
    finally:
        spark.conf.set(key, before)


def _sizes(batches):
    import pyarrow as pa

    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])
