"""Quartile bucket digests of documents.

Every byte triplet of a text is hashed into one of 128 buckets. The digest holds
a checksum byte, the text's length on a logarithmic scale, how the first two
quartiles of the bucket counts compare with the third, and two bits a bucket for
the quartile its count falls in: 35 bytes as 70 hex digits. Two digests differ
by the sum of their bucket steps plus charges for length and quartiles; likeness
is 1 at no difference and 0 from ``MOST`` on.

Defined cases: null text is empty; texts under three bytes have no triplets and
differ by length and checksum alone; equal texts have equal digests; repeated
rows each get a row; other columns are ignored. Rows without a doc_id come first
in the order of documents, and the last of them is followed by the smallest id;
the last document is followed by the smallest id too, as the order of ids closes
without them. Where no row has an id, the last of them is followed by itself.
Rows that share an id are ordered by text.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayforge.llm.common import shuffle_parts

BUCKETS = 128
#: Difference from which two digests have nothing in common.
MOST = 300
#: Charge for quartiles that lie 0, 1, 2 or 3 apart.
STEP = np.array([0, 1, 2, 6], np.int64)
LENGTH_BASE = math.log(1.1)


def digest(data: bytes) -> str:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 3:
        with np.errstate(over="ignore"):
            h = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
        counts = np.bincount(h >> np.uint32(25), minlength=BUCKETS)
    else:
        counts = np.zeros(BUCKETS, np.int64)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]].tolist()
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = code[0::4] | code[1::4] << 2 | code[2::4] << 4 | code[3::4] << 6
    length = min(255, round(math.log1p(len(data)) / LENGTH_BASE))
    ratio = lambda q: min(15, 15 * q // q3) if q3 else 0
    return bytes([zlib.crc32(data) & 255, length, ratio(q1) << 4 | ratio(q2)]).hex() + packed.astype(np.uint8).tobytes().hex()


def _codes(digests: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(bytes.fromhex("".join(digests)), np.uint8).reshape(len(digests), 3 + BUCKETS // 4)
    packed = raw[:, 3:]
    return raw[:, :3].astype(np.int64), np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(digests), BUCKETS).astype(np.int8)


def likeness(a: list[str], b: list[str]) -> np.ndarray:
    """Of each pair of digests, 0 to 1."""
    if not a:
        return np.zeros(0)
    (ha, ca), (hb, cb) = _codes(a), _codes(b)
    diff = STEP[np.abs(ca - cb)].sum(axis=1)
    diff += (ha[:, 0] != hb[:, 0]) + 6 * np.maximum(0, np.abs(ha[:, 1] - hb[:, 1]) - 1)
    diff += np.abs((ha[:, 2] >> 4) - (hb[:, 2] >> 4)) + np.abs((ha[:, 2] & 15) - (hb[:, 2] & 15))
    return 1 - np.minimum(diff, MOST) / MOST


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [digest((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def range_of(column: str, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the column's value, by two short searches."""
    if not bounds:
        return F.lit(0)
    n = math.isqrt(len(bounds) - 1) + 1
    at_most = lambda a: F.size(F.filter(a, lambda c: c <= F.col(column)))
    group = at_most(F.lit(bounds[::n]))
    inside = at_most(F.element_at(F.array(*[F.lit(bounds[i : i + n]) for i in range(0, len(bounds), n)]), group))
    return F.when(group <= 0, 0).otherwise((group - 1) * n + inside)


def with_next(docs: DataFrame) -> DataFrame:
    """(part, ahead, doc_id, text): documents in runs of ascending doc_id, dealt out by run.

    The first document of each run is also sent, marked ``ahead``, to the end of
    the run before it (of the first run: to the last one's), so that each task
    sees every document of its runs together with the next. Ids are cut at their
    quantiles; the driver holds two numbers for each run.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    parts = max(32, 2 * shuffle_parts(docs.sparkSession))
    found = docs.select(F.col("doc_id").cast("double")).approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
    placed = docs.withColumn("part", range_of("doc_id", sorted({int(x) for x in found})).cast("int"))
    firsts = [(r["part"], r["first"]) for r in placed.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect() if r["first"] is not None]
    whole = placed.select("part", F.lit(False).alias("ahead"), "doc_id", "text")
    if firsts:
        ahead = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
        if firsts[0][0] != 0:  # rows without an id are in part 0
            ahead.append((firsts[0][1], 0))
        to = docs.sparkSession.createDataFrame(ahead, "doc_id long, part int")
        copies = docs.join(F.broadcast(to), "doc_id").select("part", F.lit(True).alias("ahead"), "doc_id", "text")
        whole = whole.unionByName(copies)
    return whole.repartition(parts, "part").sortWithinPartitions("part", "ahead", "doc_id", "text")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of with_next() in order; each document once its next is known."""
    before: tuple | None = None  # part, doc_id, text, its digest
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        a, b, c = ([r[i] for r in out] for i in (3, 4, 5))
        cols = [[r[i] for r in out] for i in range(5)] + [likeness(a, b), likeness(a, c)]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def add(text: str, own: str) -> None:
        """The document before, followed by this one."""
        _, old_id, old, old_digest = before
        n = len(old)
        edited = (old[: n - n // 4] + text[: n // 4]).encode()
        out.append((old_id, n, sha256(edited).hexdigest(), old_digest, digest(edited), own))

    for batch in batches:
        for part, ahead, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("part", "ahead", "doc_id", "text")), strict=True):
            own = None
            if before is not None and before[0] == part:
                own = digest(text.encode())
                add(text, own)
            elif before is not None:
                add(before[2], before[3])  # only where no row has an id
            before = None if ahead else (part, doc_id, text, own or digest(text.encode()))
            if len(out) >= 2000:
                yield flush()
    if before is not None:
        add(before[2], before[3])
    if out:
        yield flush()


def op2_document_fingerprint(spark, sf_dir: str) -> DataFrame:
    """Every ``documents`` text, its text edited with the next document's start, and the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_next(docs).mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
