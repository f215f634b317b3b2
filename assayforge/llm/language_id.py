"""Language identification of texts and of spans within them.

Script ranges narrow the languages that a word can have (a script that training
saw in less than ``SCRIPT_SHARE`` of a language's words rules it out, unless it
rules out all). Hashed character n-grams give each word a log-likelihood by
language. Viterbi over the words, with a penalty for each switch, labels spans;
a text's language is the one with most letters, and the score their share.

The model is learned from a bounded sample of labelled rows (``SAMPLE``, those
with the smallest hash of the id), each text whole.

A path without a switch is best whenever no run of words gains more than half a
penalty in another language: a path of k other runs pays k - 1 penalties, which is
at least half of k. That is tested for all words of a text at once, and
only other texts go through the word-by-word recursion. Both are exact.

Defined cases: a null text or one without a letter is ``und`` with score 0 and
no spans; with no labelled row at all every text is; ties go to the language
that sorts first; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from assayforge.llm import charvec as cv
from assayforge.llm.common import held_out, map_texts

#: Labelled documents learned from, at most.
SAMPLE = 3000
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: Most that one word can say against a language.
WORD_LIMIT = 6.0
SCRIPT_SHARE = 0.002
SCRIPT_COST = 20.0

#: First and last code point of scripts' main blocks.
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
SCRIPT_NAMES = sorted({s[0] for s in SCRIPTS})
_script: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """Script number of each code point, 0 for none of them."""
    if not _script:
        table = np.zeros(0x110000, np.uint8)
        for name, lo, hi in SCRIPTS:
            table[lo : hi + 1] = 1 + SCRIPT_NAMES.index(name)
        _script.append(table)
    return _script[0]


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # buckets x languages, log-likelihoods
    allowed: np.ndarray  # scripts x languages

    def word_scores(self, chars: cv.Chars) -> np.ndarray:
        total = np.zeros((len(chars.start), len(self.langs)))
        for n in ORDERS:
            h = cv.gram_hash(chars.plain, n, BUCKETS)
            total += cv.span_sums(self.weight[h], *cv.gram_spans(chars, n))
        total /= len(ORDERS)
        total -= total.max(axis=1, keepdims=True) if len(total) else 0
        np.maximum(total, -WORD_LIMIT, out=total)
        allowed = self.allowed[script_table()[chars.raw[chars.start]]]
        return total - SCRIPT_COST * ~allowed


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text


def fit(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, language)."""
    langs = sorted({lang for _, lang in rows})
    count = np.zeros((BUCKETS, len(langs)))
    script = np.zeros((len(SCRIPT_NAMES) + 1, len(langs)))
    for k, lang in enumerate(langs):
        texts = [_lower(text) for text, own in rows if own == lang]
        for lo, hi in cv.chunks(texts):
            chars = cv.split(texts[lo:hi], True)
            script[:, k] += np.bincount(script_table()[chars.raw[chars.start]], minlength=len(script))
            for n in ORDERS:
                a, b = cv.gram_spans(chars, n)
                inside = np.zeros(len(chars.plain) + 2, np.int64)
                np.add.at(inside, a, 1)
                np.add.at(inside, b, -1)
                h = cv.gram_hash(chars.plain, n, BUCKETS)
                count[:, k] += np.bincount(h[np.cumsum(inside)[: len(h)] > 0], minlength=BUCKETS)
    weight = np.log(count + SMOOTHING) - np.log(count.sum(axis=0) + SMOOTHING * BUCKETS)
    share = script / np.maximum(1, script.sum(axis=0))
    allowed = share >= SCRIPT_SHARE
    allowed[0] = True
    allowed[~allowed.any(axis=1)] = True
    return Model(langs, (weight - weight.mean(axis=1, keepdims=True)).astype(np.float32), allowed)


def viterbi(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """Best language number of each word."""
    if not len(scores):
        return np.zeros(0, np.int64)
    best = int(scores.sum(axis=0).argmax())
    run = np.cumsum(scores - scores[:, [best]], axis=0)
    low = np.minimum(0, np.minimum.accumulate(np.vstack([np.zeros(scores.shape[1]), run[:-1]]), axis=0))
    if (run - low).max() <= penalty / 2:
        return np.full(len(scores), best)
    langs = range(scores.shape[1])
    value = scores[0].tolist()
    back = []
    for row in scores[1:].tolist():
        top = max(langs, key=value.__getitem__)
        least = value[top] - penalty
        came = [k if value[k] >= least else top for k in langs]
        value = [max(v, least) + s for v, s in zip(value, row, strict=True)]
        back.append(came)
    at = max(langs, key=value.__getitem__)
    path = [at]
    for came in reversed(back):
        path.append(at := came[at])
    return np.array(path[::-1])


def label(model: Model, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Of each text: language, score, spans (first and last code point plus one, language)."""
    out = []
    for lo, hi in cv.chunks(texts):
        chars = cv.split([_lower(t) for t in texts[lo:hi]], True)
        scores = model.word_scores(chars) if model.langs else np.zeros((len(chars.start), 0))
        size = chars.end - chars.start
        for i in range(hi - lo):
            a, b = int(chars.first[i]), int(chars.first[i + 1])
            if a == b or not model.langs:
                out.append(("und", 0.0, []))
                continue
            path = viterbi(scores[a:b])
            letters = np.bincount(path, size[a:b], len(model.langs))
            lang = int(letters.argmax())
            cut = np.flatnonzero(np.diff(path)) + 1
            firsts, lasts = np.concatenate([[0], cut]), np.concatenate([cut, [b - a]]) - 1
            begin, finish = chars.start[a + firsts] - chars.at[i], chars.end[a + lasts] - chars.at[i]
            spans = [(s, e, model.langs[k]) for s, e, k in zip(begin.tolist(), finish.tolist(), path[firsts].tolist(), strict=True)]
            out.append((model.langs[lang], float(letters[lang] / letters.sum()), spans))
    return out


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """From labelled rows of (doc_id, text, lang) that are not held out."""
    known = docs.where(~held_out() & F.col("lang").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"), "text")
    few = known.select("h").orderBy("h").limit(sample).collect()
    if not few:
        return fit([])
    rows = known.where(F.col("h") <= few[-1]["h"]).orderBy("h", "lang", F.md5("text")).limit(sample).select("doc_id", "text", "lang").collect()
    return fit([(r["text"] or "", r["lang"]) for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"]))])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of (doc_id, text): doc_id, lang_pred, score, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = label(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            spans = [[dict(zip(("start", "end", "lang"), s, strict=True)) for s in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(spans, kind)],
                ["doc_id", "lang_pred", "score", "spans"],
            )

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(docs, run, "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>")


def annotate(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; its own columns of these names must be gone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = label(shared.value, [t or "" for t in batch.column("text").to_pylist()])
            more = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score"])

    return map_texts(docs, run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
