import numpy as np

from assayforge.llm import quality as q
from assayforge.llm.common import held_out
from tests.conftest import SMALL
from tests.llm import cases


def test_scores_are_averages_of_features():
    weight = np.random.default_rng(0).normal(size=q.BUCKETS).astype(np.float32)
    texts = [t or "" for _, t in cases.documents()]
    want = []
    for text in texts:
        bucket, share = q.features(text)
        want.append(1 / (1 + np.exp(-(0.3 + float(share @ weight[bucket])))))
    assert np.allclose(q.scores(weight, 0.3, texts), want, atol=1e-6)


def test_learns_repetition():
    rng = __import__("random").Random(1)
    good = [(" ".join(cases.words(rng, 60)), 1) for _ in range(60)]
    bad = [(" ".join(w for w in cases.words(rng, 8) for _ in range(8)), 0) for _ in range(60)]
    model = q.fit(good[:50] + bad[:50])
    s = q.scores(*model, [t for t, _ in good[50:] + bad[50:]])
    assert s[:10].min() > s[10:].max()


def test_held_out_accuracy(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").where(held_out()).collect()}
    rows = q.op8_quality_classifier(spark, SMALL).collect()
    got = {r["doc_id"]: r for r in rows if r["held_out"]}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert np.mean([got[i]["predicted"] == y for i, y in labels.items() if i in got]) >= 0.85


def test_empty_and_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.train(cases.table(spark), labels)
    rows = q.score(cases.table(spark), model).collect()
    assert len(rows) == len(cases.documents()) and {r["score"] for r in rows} == {0.5}
    assert q.score(cases.empty(spark), model).count() == 0
    odd = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, None, 1), (None, 1, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    assert q.score(cases.table(spark), q.train(cases.table(spark), odd)).count() == len(rows)
