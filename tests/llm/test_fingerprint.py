import hashlib

import numpy as np

from assayforge.llm.fingerprint import _compare, digest, fingerprints, likeness, range_of, with_next
from tests.llm import cases

SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def brute(rows):
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), digest(text.encode()), digest(edited.encode()), likeness([digest(text.encode())], [digest(after.encode())])[0])
    return out


def run(df):
    return with_next(df).mapInArrow(_compare, SCHEMA)


def test_same_as_brute_force(spark):
    rows = cases.documents()
    got = {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_next"]) for r in run(cases.table(spark, rows)).collect()}
    assert got == brute(rows)


def test_one_document_follows_itself(spark):
    r = run(cases.table(spark, [(4, "abcdefgh")])).collect()[0]
    assert r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and r["near_next"] == 1.0


def test_empty_and_repeated(spark):
    assert run(cases.empty(spark)).count() == 0
    assert run(cases.table(spark, [(1, "abc"), (1, "abc"), (None, "x"), (2, None)])).count() == 4


def test_rows_without_id_come_first_and_the_order_of_ids_closes_without_them(spark):
    def followed(rows):
        out = run(cases.table(spark, rows)).collect()
        return sorted((r["doc_id"] or 0, r["edited_sha256"]) for r in out)

    def edited(text, after):
        return hashlib.sha256((text[:6] + after[:2]).encode()).hexdigest()

    x, y, a, b = "xxxxxxxx", "yyyyyyyy", "aaaaaaaa", "bbbbbbbb"
    want = sorted([(0, edited(x, y)), (0, edited(y, a)), (1, edited(a, b)), (2, edited(b, a))])
    assert followed([(2, b), (None, y), (1, a), (None, x)]) == want
    assert followed([(None, y), (None, x)]) == sorted([(0, edited(x, y)), (0, edited(y, y))])


def test_likeness_is_bounded_and_equal_texts_agree():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 97 + k, n).astype(np.uint8)) for k in (2, 10, 26) for n in (0, 1, 2, 3, 50, 5000)]
    a = [digest(t) for t in texts]
    assert (likeness(a, a) == 1).all()
    for x in a:
        near = likeness([x] * len(a), a)
        assert (near >= 0).all() and (near <= 1).all()
    text = bytes(rng.integers(97, 123, 4000).astype(np.uint8))
    assert likeness([digest(text)], [digest(text[:-40] + b"y" * 40)])[0] > 0.8


def test_fingerprints_of_clashing_table(spark):
    got = {r["doc_id"]: r["fingerprint"] for r in fingerprints(cases.table(spark)).collect()}
    assert got == {i: digest((t or "").encode()) for i, t in cases.documents()}


def test_range_of(spark):
    bounds = [-3, 0, 7, 7 + 1, 100, 2**60]
    rows = [(x,) for x in (-9, -3, -1, 0, 6, 7, 8, 50, 100, 2**60 + 1)]
    got = spark.createDataFrame(rows, "x long").select("x", range_of("x", bounds).alias("r")).collect()
    assert all(r["r"] == sum(b <= r["x"] for b in bounds) for r in got)
