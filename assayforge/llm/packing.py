"""Packing of tokenised documents into as few fixed-size sequences as possible.

Pieces of one length are interchangeable, so the packing is decided on the
histogram of lengths (at most ``size`` numbers, whatever the corpus):

1. Martello-Toth reduction: a set of up to three pieces that provably dominates
   every other set with its largest piece is fixed for good, as often as it can
   be had (exact fills first), until nothing more can be fixed.
2. The remainder is packed best-fit, longest first.

The plan says which ranks of each length go to which sequence and offset. Pieces
get their rank within their length from a count by (length, bucket), a running
sum over buckets and a row number within each bucket, so that no task holds all
pieces of a hot length.

Texts are cut at single spaces before visible characters, where the tokenizer
always cuts too; the ids of such a chunk are kept in a bounded memo. Ids come
from the vocabulary and merges of the ``tokenizers`` file; tests hold them
against that library.

Defined cases: null text is empty, and an empty document is one piece of one
token (the end id). Repeated rows are packed as often as they occur. Other
columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assayforge.llm.common import checkpointed, map_texts

SIZE = 1024
END_ID = 2
#: Chunks that a worker remembers, in two generations.
MEMO = 120_000
#: Pieces in a bucket, about.
BUCKET_ROWS = 50_000


class _Memo(dict):
    """chunk -> ids of " " + chunk as little-endian bytes."""

    def __init__(self, encode):
        self.encode, self.old = encode, {}

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        found = self.old.get(chunk)
        if found is None:
            if not chunk or chunk[0].isspace():
                raise KeyError(chunk)
            found = self.encode(" " + chunk)
        self[chunk] = found
        return found


class Encoder:
    """Byte-level BPE ids of a ``tokenizers`` JSON file, as bytes of unsigned 32-bit ids."""

    def __init__(self, path: str):
        import re

        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        shown = _byte_letters()
        ranks = {bytes(shown[c] for c in word): i for word, i in spec["model"]["vocab"].items() if all(c in shown for c in word)}
        merged = [bytes(shown[c] for part in (m.split(" ") if isinstance(m, str) else m) for c in part) for m in spec["model"]["merges"]]
        if [ranks[m] for m in merged] != sorted(ranks[m] for m in merged):
            raise ValueError("ids must follow the order of merges")
        import public_tokenizers

        core = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self._plain = lambda text: np.array(core.encode_ordinary(text), np.uint32).tobytes()
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None
        self._memo = _Memo(self._plain)

    def encode(self, text: str) -> bytes:
        if self._cut and any(t in text for t in self._special):
            return b"".join(np.uint32(self._special[x]).tobytes() if x in self._special else self._run(x) for x in self._cut.split(text) if x)
        return self._run(text)

    def _run(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        try:
            return b"".join([self._plain(first), *map(self._memo.__getitem__, rest)])
        except KeyError:  # runs of white space are cut by longer context
            return self._plain(text)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _emit_pieces(path: str, size: int, end_id: int):
    tail = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path).encode
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = code(text or "") + tail
                n = len(ids) // 4
                start, length, piece = 0, n - size * ((n - 1) // size), 0
                while start < n:
                    for column, value in zip(out, (doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                        column.append(value)
                    start, length, piece = start + length, size, piece + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def _reduce(count: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes dominating sets of up to three pieces; takes them out of ``count``."""
    fixed = []

    def fix(items: tuple[int, ...]) -> None:
        times = min(int(count[x]) // items.count(x) for x in items)
        for x in items:
            count[x] -= times
        fixed.append((items, times))

    def largest(most: int, taken: tuple[int, ...]) -> int:
        """The largest length up to ``most`` that is left beside what is taken; 0: none."""
        if most <= 0:
            return 0
        left = count[: most + 1].copy()
        for x in taken:
            if x <= most:
                left[x] -= 1
        found = np.flatnonzero(left > 0)
        return int(found[-1]) if len(found) else 0

    for big in range(size, 0, -1):  # two pieces that fill a sequence exactly dominate all else
        if big == size and count[big]:
            fix((big,))
        elif big > size - big > 0 and count[big] and count[size - big]:
            fix((big, size - big))
        elif 2 * big == size and count[big] > 1:
            fix((big, big))
    changed = True
    while changed:
        changed = False
        for big in range(size, 0, -1):
            while count[big] > 0:
                room = size - big
                rest = count.copy()
                rest[big] -= 1
                small = np.flatnonzero(rest > 0)[:3]
                few = np.repeat(small, np.minimum(rest[small], 3))[:3].tolist()
                if not few or few[0] > room:
                    fix((big,))
                    changed = True
                    continue
                k = largest(room, (big,))
                if k == room or len(few) < 2 or few[0] + few[1] > room:
                    fix((big, k))
                    changed = True
                    continue
                if len(few) > 2 and sum(few) <= room:
                    break
                # At most two more pieces fit.
                have = np.flatnonzero(rest[: room + 1] > 0)
                pairs = [(x + y, y) for y in have.tolist() if 2 * y <= room for x in [largest(room - y, (big, y))] if x >= y]
                if not pairs or k >= max(p[0] for p in pairs):
                    fix((big, k))
                    changed = True
                    continue
                a = largest(room - k, (big, k))
                if a and a >= max(p[1] for p in pairs):
                    fix((big, k, a))
                    changed = True
                    continue
                break
    return fixed


def _best_fit(count: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit, longest first, over groups of sequences with equal contents."""
    room: dict[int, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for length in np.flatnonzero(count)[::-1].tolist():
        left = int(count[length])
        for r in range(length, size):
            while left and room.get(r):
                items, have = room[r].popitem()
                times = min(have, left)
                if have > times:
                    room[r][items] = have - times
                room[r - length][(*items, length)] += times
                left -= times
        each = size // length
        if left // each:
            room[size - each * length][(length,) * each] += left // each
        if left % each:
            room[size - left % each * length][(length,) * (left % each)] += 1
    return [(items, times) for group in room.values() for items, times in group.items()]


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """Contents of sequences and how many there are of each."""
    count = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    count[0] = 0
    return _reduce(count, size) + _best_fit(count, size)


def _slots(histogram: dict[int, int], size: int) -> np.ndarray:
    """Rows of (length, first rank, first sequence, offset), sorted."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for items, times in plan(histogram, size):
        offset = 0
        for length in items:
            rows.append((length, used[length], base, offset))
            used[length] += times
            offset += length
        base += times
    return np.array(sorted(rows) or np.zeros((0, 4)), np.int64)


def _emit_places(slots: np.ndarray):
    wide = np.int64(1) << 50
    keys = slots[:, 0] * wide + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column("rank"))
            at = np.searchsorted(keys, np.asarray(batch.column("length")) * wide + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(slots[at, 2] + rank - slots[at, 1]), pa.array(slots[at, 3])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids and ``end_id``; if longer than ``size`` it is cut into
    pieces of ``size`` ids, of which the first may be shorter.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = checkpointed(map_texts(docs, _emit_pieces(path, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = pieces.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start")).cast("long") - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked.select(*columns, "rank").mapInArrow(_emit_places(_slots(histogram, size)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of 1024 tokens."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
