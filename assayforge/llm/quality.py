"""Supervised subword embeddings that score document quality.

Words, word pairs and character n-grams are hashed into learned vectors, which
are averaged over a document; a softmax layer gives the class. Training is plain
numpy stochastic gradient descent on a bounded sample of labelled rows
(``SAMPLE``, those with the smallest hash of the id), each text whole. A pair of
equal words is one feature of its own, whatever the word.

As the layer is linear, scoring needs one number a bucket: its vector's part of
the difference between the two classes.

Defined cases: null and empty texts get the score of the bias alone; with no
labelled row every score is 0.5; with a single class in the sample scores are as
learned from it; repeated rows each get a row; a document with several labels
counts once for each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from assayforge.llm import charvec as cv
from assayforge.llm.common import held_out, map_texts
from assayforge.llm.textvec import WORD_BASE, mix

#: Labelled documents learned from, at most.
SAMPLE = 2000
BUCKETS = 1 << 16
ORDERS = (2, 3, 4)
DIM = 10
EPOCHS = 5
RATE = 0.6
#: Score from which a document counts as good.
GOOD = 0.7


def _word_buckets(chars: cv.Chars) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and of it with the next word (of any text)."""
    h = cv.word_hash(chars)
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * np.uint64(WORD_BASE) + h[1:]) if len(h) else h
    pair = (pair & np.uint64(BUCKETS - 1)).astype(np.int64)
    pair[h[:-1] == h[1:]] = 0
    return (h >> np.uint64(11) & np.uint64(BUCKETS - 1)).astype(np.int64), pair


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and the share of each."""
    chars = cv.split([text], False)
    word, pair = _word_buckets(chars)
    found = [word, pair]
    for n in ORDERS:
        lo, hi = cv.gram_spans(chars, n)
        h = cv.gram_hash(chars.plain, n, BUCKETS)
        at = np.repeat(lo, hi - lo) + np.arange(int((hi - lo).sum())) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
        found.append(h[at].astype(np.int64))
    bucket, n = np.unique(np.concatenate(found), return_counts=True)
    return bucket, n / max(1, n.sum())


def fit(rows: list[tuple[str, int]], seed: int = 0) -> tuple[np.ndarray, float]:
    """rows: (text, 0 or 1). Returns the weight of each bucket and the bias, as log-odds of 1."""
    rng = np.random.default_rng(seed)
    vector = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((2, DIM)), np.zeros(2)
    docs = [(features(text), label) for text, label in rows]
    steps, step = max(1, EPOCHS * len(docs)), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            (bucket, share), label = docs[i]
            hidden = share @ vector[bucket]
            z = layer @ hidden + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[label] -= 1
            rate = RATE * (1 - step / steps)
            step += 1
            back = error @ layer
            layer -= rate * np.outer(error, hidden)
            bias -= 0.1 * rate * error
            # An average of many vectors passes each a small share; the root keeps long texts learning.
            vector[bucket] -= rate * np.outer(np.sqrt(share), back)
    return (vector @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0])


def scores(weight: np.ndarray, bias: float, texts: list[str]) -> np.ndarray:
    out = np.zeros(len(texts))
    for lo, hi in cv.chunks(texts):
        chars = cv.split(texts[lo:hi], False)
        word, pair = _word_buckets(chars)
        total = weight[word].astype(np.float64)
        count = np.ones(len(total))
        last = np.zeros(len(total) + 1, bool)
        last[chars.first[1:]] = True
        inner = np.flatnonzero(~last[1 : len(total)])  # words that have a next one in their text
        total[inner] += weight[pair[inner]]
        count[inner] += 1
        for n in ORDERS:
            a, b = cv.gram_spans(chars, n)
            total += cv.span_sums(weight[cv.gram_hash(chars.plain, n, BUCKETS)], a, b)
            count += b - a
        first = chars.first
        sums = np.concatenate([[0], np.cumsum(total)])
        counts = np.concatenate([[0], np.cumsum(count)])
        z = bias + (sums[first[1:]] - sums[first[:-1]]) / np.maximum(1, counts[first[1:]] - counts[first[:-1]])
        out[lo:hi] = 1 / (1 + np.exp(-z))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """From rows of labels (doc_id, quality) that are not held out and the texts of docs."""
    known = labels.where(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality"))
    few = known.select(F.xxhash64("doc_id").alias("h")).orderBy("h").limit(sample).collect()
    if not few:
        return np.zeros(BUCKETS, np.float32), 0.0
    # At most ``sample`` labels are sent to the texts, and as many texts come back, also where ids repeat.
    first = F.xxhash64("doc_id").alias("h")
    chosen = known.where(F.xxhash64("doc_id") <= few[-1]["h"]).select("*", first).orderBy("h", "quality").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = found.orderBy("h", "quality", F.md5("text")).limit(sample).collect()
    return fit([(r["text"] or "", r["quality"]) for r in sorted(rows, key=lambda r: r["doc_id"])])


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """Per row of (doc_id, text): doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(*shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_texts(docs, run, "doc_id long, score double")


def annotate(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """``docs`` with its score; a column of this name must be gone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = scores(*shared.value, [t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "score"])

    return map_texts(docs, run, StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
