import random

import numpy as np

from assayforge.llm import language_id as li
from assayforge.llm.common import held_out
from tests.conftest import SMALL
from tests.llm import cases

RNG = random.Random(0)
TRAIN = [(" ".join(cases.words(RNG, 60, "abcdeimnost")), "aa") for _ in range(30)] + [(" ".join(cases.words(RNG, 60, "fghjklpqruvy")), "bb") for _ in range(30)] + [(" ".join(cases.words(RNG, 60, "абвгдежзик")), "cc") for _ in range(30)]
MODEL = li.fit(TRAIN)


def slow_viterbi(scores, penalty):
    t, k = scores.shape
    value, back = scores[0].copy(), []
    for row in scores[1:]:
        move = value[None, :] - penalty * (1 - np.eye(k))
        back.append(move.argmax(axis=1))
        value = move.max(axis=1) + row
    best = value.max()
    return best


def total(scores, path, penalty):
    return scores[np.arange(len(path)), path].sum() - penalty * (np.diff(path) != 0).sum()


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(300):
        s = rng.normal(size=(rng.integers(1, 30), rng.integers(1, 5))) * rng.uniform(0.1, 4)
        path = li.viterbi(s, 2.0)
        assert abs(total(s, path, 2.0) - slow_viterbi(s, 2.0)) < 1e-9


def test_spans_of_mixed_text():
    a, b = " ".join(cases.words(RNG, 25, "abcdeimnost")), " ".join(cases.words(RNG, 25, "fghjklpqruvy"))
    ((lang, score, spans),) = li.label(MODEL, [a + ". " + b])
    assert [s[2] for s in spans] == ["aa", "bb"]
    assert abs(spans[1][0] - (len(a) + 2)) <= 8 and 0.3 < score < 0.7 and lang in ("aa", "bb")


def test_script_rules_languages_out():
    assert [x[0] for x in li.label(MODEL, ["жзик", "abc"])] == ["cc", "aa"]


def test_without_letters():
    assert li.label(MODEL, ["", "123 !!", "\n"]) == [("und", 0.0, [])] * 3
    assert li.label(li.fit([]), ["abc"]) == [("und", 0.0, [])]


def test_table(spark):
    docs = cases.table(spark)
    rows = li.identify(docs, MODEL).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert li.identify(cases.empty(spark), MODEL).count() == 0
    assert li.train(cases.empty(spark)).langs == []


def test_held_out_accuracy(spark):
    from assayforge.llm.language_id import op6_language_id

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.where(held_out()).collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in op6_language_id(spark, SMALL).where("held_out").collect()}
    assert set(got) == set(truth)
    assert np.mean([got[i] == truth[i] for i in got]) >= 0.95
