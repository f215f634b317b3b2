import random
from collections import Counter
from pathlib import Path

import numpy as np

from assayforge.llm import near_dedup as nd
from assayforge.llm.common import checkpointed
from assayforge.llm.near_dedup import banded, labelled, matches, near_duplicates
from tests.llm import cases


def lcs(a, b):
    """The plain table, row by row."""
    number = {x: i for i, x in enumerate([*a, *b])}
    b = np.array([number[y] for y in b])
    row = np.zeros(len(b) + 1, int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == number[x])))
    return int(row[-1])


def shingles(text):
    w = (text or "").split()
    return [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []


def brute(rows):
    sh = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sh}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sh)
    for k, x in enumerate(ids):
        for y in ids[k + 1 :]:
            a, b = sh[x], sh[y]
            if a and b and (a == b or (c := sum((Counter(a) & Counter(b)).values())) / (len(a) + len(b) - c) >= 0.8 and (m := lcs(a, b)) / (len(a) + len(b) - m) >= 0.8):
                p, q = top(x), top(y)
                root[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def test_same_as_brute_force(spark):
    rows = cases.documents()
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(cases.table(spark, rows)).collect()}
    assert got == brute(rows)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(2)
    base = cases.words(rng, 150)
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(cases.table(spark, rows)).collect()}
    assert got == brute(rows)


def test_empty_nulls_and_repeats(spark):
    assert near_duplicates(cases.empty(spark)).count() == 0
    rows = [(3, "a b c d e f g"), (3, "a b c d e f g"), (1, "a b c d e f g"), (9, None), (8, ""), (None, "a b c d e f g"), (7, "x y"), (6, "x y")]
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["class_id"]) for r in near_duplicates(cases.table(spark, rows)).collect())
    assert got == [(-1, None), (1, 1), (3, 1), (3, 1), (6, 6), (7, 6), (8, 8), (9, 9)]


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (rng.integers(0, 9, rng.integers(1, 25)).astype(np.uint32) for _ in range(2))
        if rng.random() < 0.5:
            b = np.delete(a, rng.integers(0, len(a))) if len(a) > 1 else a
        m = lcs(a.tolist(), b.tolist())
        assert banded(a, b, 40) == m
        assert matches(a, b, 0.8) == (m / (len(a) + len(b) - m) >= 0.8 - 1e-12)


def test_labels_tell_repeats_apart():
    h = np.array([5, 5, 6, 5, 5], np.uint64)
    out = labelled(h, np.array([0, 3, 5]))
    assert out[0] == out[3] and out[1] == out[4] and len(set(out.tolist())) == 3


def test_alignment_of_texts_that_one_passage_fills():
    rng = np.random.default_rng(3)
    for _ in range(60):
        a, b = (rng.integers(0, 2, rng.integers(60, 150)).astype(np.uint32) for _ in range(2))
        m = lcs(a.tolist(), b.tolist())
        assert nd._bit_rows(a, b) == m
        assert matches(a, b, 0.8) == (9 * m >= 4 * (len(a) + len(b)))
    same = np.ones(60_000, np.uint32)
    assert matches(same, same[:50_000], 0.8) and not matches(same, same[:47_000], 0.8)


def test_very_long_texts_align():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 32, 1_000_000, dtype=np.uint64).astype(np.uint32)
    near, far = a.copy(), a.copy()
    near[rng.integers(0, len(a), 60_000)] = 7
    far[rng.integers(0, len(a), 160_000)] = 7
    assert matches(a, near, 0.8) and not matches(a, far, 0.8)


def test_signatures_never_rule_out_more_than_is_apart():
    rng = np.random.default_rng(5)
    for _ in range(100):
        a = rng.integers(0, 2**63, rng.integers(1, 400), dtype=np.uint64)
        b = np.concatenate([np.delete(a, rng.integers(0, len(a), rng.integers(0, 30))), rng.integers(0, 2**63, rng.integers(0, 30), dtype=np.uint64)])
        x, y = (np.frombuffer(nd.signature(v), np.uint64) for v in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_large_bucket_in_chunks_on_both_sides_of_the_threshold(spark, monkeypatch):
    """Near copies of one text, more than a chunk holds, with 0 to 14 edits of 150 words."""
    monkeypatch.setattr(nd, "CHUNK", 32)
    rng = random.Random(6)
    base = cases.words(rng, 150)
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 14)):
            w[rng.randrange(len(w))] = "new" + str(rng.random())
        rows.append((i, " ".join(w)))
    want = brute(rows)
    assert 20 < len(set(want.values())) < 240
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(cases.table(spark, rows)).collect()}
    assert got == want


def test_short_texts_that_differ_by_one_shingle(spark):
    rng = random.Random(7)
    rows = []
    for i in range(150):
        w = cases.words(rng, rng.randint(8, 12))
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w, "more"]))]
    got = {r["doc_id"]: r["class_id"] for r in near_duplicates(cases.table(spark, rows)).collect()}
    assert got == brute(rows) and all(got[2 * i + 1] == 2 * i for i in range(150))


def test_few_documents_are_few_checkpoint_files(spark):
    checkpointed(spark.range(1))
    top = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    known = set(top.iterdir())
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        got = {r["doc_id"]: r["class_id"] for r in near_duplicates(cases.table(spark)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == brute(cases.documents())
    files = [len(list(d.glob("part-*"))) for d in top.iterdir() if d not in known]
    assert len(files) > 5 and max(files) <= 4 * spark.sparkContext.defaultParallelism
