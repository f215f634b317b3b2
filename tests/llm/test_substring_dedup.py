import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from assayforge.llm import bindings, substring_dedup
from assayforge.llm import textvec as tv
from assayforge.llm.substring_dedup import remove_repeats
from tests.conftest import SMALL
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    seen, out = set(), {}
    for i, text in sorted((i, t or "") for i, t in rows):
        w = WORD.findall(text)
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            key = tuple(w[j : j + window])
            if key in seen:
                gone[j : j + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def found(df, **kw):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in remove_repeats(df, **kw).collect()}


def test_same_as_brute_force(spark):
    rows = cases.documents()
    assert found(cases.table(spark, rows)) == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(rows).items()}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in bindings.QUERIES["op1_substring_dedup"](spark, SMALL).collect()}
    assert got == want


def test_empty_table(spark):
    assert remove_repeats(cases.empty(spark)).count() == 0


def test_rows_without_id_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = cases.table(spark, [(1, text), (1, text), (2, text), (None, text)])
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_removed"]) for r in remove_repeats(df).collect())
    assert got == [(False, 1, 0), (False, 1, 0), (False, 2, 30), (True, 0, 0)]


def test_as_is_keeps_white_space(spark):
    df = cases.table(spark, [(1, "a  b\n c"), (2, "x " * 45)])
    got = found(df, as_is=True)
    assert got[1][2] == "a  b\n c"
    assert got[2] == brute([(2, "x " * 45)])[2]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(texts=st.lists(st.lists(st.sampled_from("abc"), max_size=40), min_size=1, max_size=8), window=st.integers(2, 6))
def test_small_windows(spark, texts, window):
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(cases.table(spark, rows), window=window, phrase=max(1, window - 2)) == brute(rows, window)


def test_phrase_longer_than_window(spark):
    with pytest.raises(ValueError):
        remove_repeats(cases.empty(spark), window=3, phrase=4)


def test_hot_passage_and_equal_starts(spark):
    passage = " ".join(f"hot{i}" for i in range(24))
    rows = [(i, f"{' '.join(f'a{i}x{k}' for k in range(i % 9))} {passage} {'again ' * (i % 3 * 15)}") for i in range(240)]
    rows.append((500, f"{passage} {passage} {passage}"))
    assert found(cases.table(spark, rows)) == brute(rows)


def shard():
    """Words of three texts with one passage, and the confirmed phrases, which only the first text is told of."""
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join([*(f"{x}{i}" for i in range(15)), *passage, x, x]) for x in "abc"]
    (words,) = tv.words_of(pa.array(texts))
    _, at, grams = substring_dedup.anchors(words, 20, 8)
    at = np.unique(at)
    value, n = np.unique(grams[at], return_counts=True)
    told = [a for a in at.tolist() if a < words.first[1] and n[value == grams[a]][0] > 1]
    return texts, words, at, grams, substring_dedup.keys_of(words, np.array(told), 8)


def test_automaton_finds_every_occurrence():
    texts, words, at, grams, keys = shard()
    symbols = substring_dedup.spelled(words.hash >> np.uint64(48))
    listed = {substring_dedup.spelled(k.view("<u2")) for k in keys}
    docs = words.doc_of()
    want = [i for i in range(len(symbols) - 7) if symbols[i : i + 8] in listed and docs[i] == docs[i + 7]]
    assert np.flatnonzero(substring_dedup.located(words, 8, keys)).tolist() == want
    assert len(want) == 3 * len(listed) > 0


def test_nothing_is_removed_without_the_automaton(monkeypatch):
    texts, words, at, grams, keys = shard()
    kind = pa.list_(pa.struct([("key_0", pa.int64()), ("key_1", pa.int64())]))
    phrases = pa.array([[{"key_0": int(a), "key_1": int(b)} for a, b in keys], None, None], kind)
    none = pa.array([None] * 3, pa.list_(pa.int64()))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3], "text": texts, "first": [True] * 3, "phrases": phrases, "owned": none, "later_copy": [False] * 3})

    def removed():
        (out,) = substring_dedup._emit_kept(20, 8, False, 0)(iter([batch]))
        return out.column("n_removed").to_pylist(), [b.num_rows for b in substring_dedup._emit_windows(20, 8)(iter([batch]))]

    gone, windows = removed()
    assert min(gone) >= 20 and sum(windows) > 0
    monkeypatch.setattr(substring_dedup, "located", lambda words, phrase, keys: np.zeros(len(words.hash), bool))
    assert removed() == ([0, 0, 0], [])
