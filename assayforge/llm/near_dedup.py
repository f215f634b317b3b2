"""Near-duplicate classes by order MinHash.

A document is the sequence of its shingles of five words, each labelled with how
often it occurred before. For each of ``SKETCHES`` hash functions the
``TUPLE`` smallest labelled shingles are kept in text order; that tuple is a
bucket key. Documents that share a key are candidates. A pair is linked if
aligning the two shingle sequences in order, m of n and k matched, gives
m / (n + k - m) >= ``SIMILAR``; the band of the alignment is the widest that this
similarity allows, so the band loses nothing. Classes are the connected
components of links; the class id is the smallest doc_id.

At similarity 0.8 a pair has no key in common with probability about
(1 - 0.8 ** 4) ** 20 = 0.00003; that is the method's own loss. Texts of few shingles
would lose more, so those of ``TUPLE`` to ``FEW`` shingles also get the key of the
whole sequence and of the sequence without each one of its shingles: a pair that
differs by one shingle is always compared.

Exact copies are one candidate. A bucket is not expanded into pairs: first its
smallest id is compared with the rest. Of buckets that are still of several classes only marks
travel: id, class, length, keys and a parity signature of ``BITS`` bits, about 300
bytes a member whatever its text is, in chunks of about ``CHUNK`` members; a bucket
of c chunks sends each of them to c tasks. A task looks at every pair of two chunks,
of different classes, in the first bucket that the pair shares. It rules a pair out
only by what is certain: lengths that 0.8 does not allow, or more bits of
difference between the signatures than shingles may go unmatched (a shingle flips
one bit, so there are never more differing bits than unmatched shingles). First
each member's best partner is aligned; then, with the classes that gives, every pair
that was not ruled out. So no candidate goes untested, whatever the size of a
bucket. Links and classes stay distributed.

Defined cases: null texts and texts without words are classes of their own;
texts of one to four words are one shingle; rows that share a doc_id share a
class, the smallest found; rows without a doc_id have class null; other columns
are ignored. Very long texts: the alignment takes time by the places where the two
texts agree, and where one passage fills both, a 64th of the product of their
lengths; its memory stays in proportion to the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.llm import textvec as tv
from assayforge.llm.common import checkpointed, map_texts, spread

SHINGLE = 5
SKETCHES = 20
TUPLE = 4
SIMILAR = 0.8
#: Members of a bucket whose marks are compared in one task with as many others', about.
CHUNK = 1024
#: Links that one task looks after when classes are joined.
LINKS = 200_000
#: Documents whose marks are one file of a checkpoint, about.
FILE_ROWS = 20_000
#: Bits of the parity signature.
BITS = 1024
#: Texts of up to so many shingles also get the keys that allow for one shingle less.
FEW = 9
#: Places of agreement for each shingle, above which an alignment is done in bit rows.
DENSE = 32
#: Bytes of bit rows that an alignment remembers.
ROWS = 1 << 26


def shingles(words: tv.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the shingles of all texts, where each text's begin)."""
    count = np.diff(words.first)
    whole = words.whole(k)
    hashes = words.windows(k)
    # A text of fewer words is one shingle: the same roll over what there is.
    short = np.flatnonzero((count > 0) & (count < k))
    for doc in short.tolist():
        a, b = int(words.first[doc]), int(words.first[doc + 1])
        hashes[a] = tv.roll(words.hash[a:b], b - a)[0] ^ np.uint64(b - a)
        whole[a] = True
    at = np.flatnonzero(whole)
    return hashes[at], np.searchsorted(at, words.first)


def labelled(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes that also tell a shingle's earlier occurrences in its text."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    begins = np.flatnonzero(fresh)
    nth = np.arange(len(h)) - np.repeat(begins, np.diff(np.append(begins, len(h))))
    out = np.empty_like(hashes)
    with np.errstate(over="ignore"):
        out[order] = tv.mix(h + nth.astype(np.uint64) * np.uint64(tv.BYTE_BASE))
    return out


def sketch(own: np.ndarray, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """Bucket keys of one text's labelled shingles."""
    factor = tv.mix(np.arange(1, sketches + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        if len(own) > size:
            at = np.sort(np.argpartition(own[None, :] * factor[:, None], size - 1, axis=1)[:, :size], axis=1)
        else:
            at = np.tile(np.arange(len(own)), (sketches, 1))
        return tv.mix((own[at] * tv.powers(tv.WORD_BASE, at.shape[1])).sum(axis=1) + factor)


def few_keys(own: np.ndarray) -> np.ndarray:
    """Keys of a text's whole sequence and of it without each one of its shingles."""
    with np.errstate(over="ignore"):
        rows = [own, *(np.delete(own, i) for i in range(len(own)))]
        return tv.mix(np.array([(r * tv.powers(tv.WORD_BASE, len(r))).sum() + np.uint64(len(r)) * np.uint64(tv.BYTE_BASE) for r in rows], np.uint64))


def signature(own: np.ndarray) -> bytes:
    """Of each of ``BITS`` bits, whether an odd number of labelled shingles falls on it."""
    return np.packbits(np.bincount((own >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1).tobytes()


def _emit_sketches(k: int, sketches: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tv.words_of(batch.column("text")):
                hashes, first = shingles(words, k)
                own = labelled(hashes, first)
                lo, hi = words.rows
                some = np.flatnonzero(np.diff(first))
                keys = []
                for i in some.tolist():
                    mine = own[first[i] : first[i + 1]]
                    keys.append(sketch(mine, sketches, size))
                    if size <= len(mine) <= FEW:
                        keys[-1] = np.concatenate([keys[-1], few_keys(mine)])
                off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32))
                values = pa.array(tv.signed(np.concatenate(keys)) if keys else np.zeros(0, np.int64))
                at = pa.array(some)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(at), part.column("print").take(at), pa.ListArray.from_arrays(off, values)], ["doc_id", "print", "keys"])

    return run


def _emit_sequences(k: int):
    """Rows of (doc_id, shingle hashes of 32 bits as bytes, how many, parity signature)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words in tv.words_of(batch.column("text")):
                hashes, first = shingles(words, k)
                own = labelled(hashes, first)
                raw = (hashes >> np.uint64(32)).astype(np.uint32).tobytes()
                lo, hi = words.rows
                spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                columns = [
                    batch.column("doc_id").slice(lo, hi - lo),
                    pa.array([raw[4 * a : 4 * b] for a, b in spans], pa.binary()),
                    pa.array(np.diff(first).astype(np.int32)),
                    pa.array([signature(own[a:b]) for a, b in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "seq", "length", "sig"])

    return run


def _rising(x: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    if len(x) < 2 or (np.diff(x) > 0).all():
        return len(x)
    from bisect import bisect_left

    ends: list[int] = []
    for v in x.tolist():
        i = bisect_left(ends, v)
        ends[i : i + 1] = [v]
    return len(ends)


def matches(a: np.ndarray, b: np.ndarray, similar: float) -> bool:
    """Whether aligning the two sequences reaches the similarity."""
    needed = int(np.ceil(similar / (1 + similar) * (len(a) + len(b)) - 1e-9))
    band = len(a) + len(b) - 2 * needed
    short = min(len(a), len(b))
    if short < needed:
        return False
    # What the texts begin and end with in common is part of some best alignment.
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b, short = a[head:], b[head:], short - head
    differ = np.flatnonzero(a[::-1][:short] != b[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    a, b, needed = a[: len(a) - tail], b[: len(b) - tail], needed - head - tail
    if needed <= 0:
        return True
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    in_a = np.bincount(np.searchsorted(values, a), minlength=len(values))
    if np.minimum(in_a, counts - in_a).sum() < needed:
        return False  # even without order there are too few in common
    return banded(a, b, band) >= needed


def banded(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence over cells at most ``band`` off the diagonal, or a longer one
    where a passage that fills both makes bit rows the shorter way."""
    order = np.argsort(b, kind="stable")
    lo, hi = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    times = hi - lo
    if times.sum() > DENSE * (len(a) + len(b)):
        return _bit_rows(a, b)
    # Cells that agree, row by row, from the right: a rising run has one of each row at most.
    row = np.repeat(np.arange(len(a)), times)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
    column = order[hi[row] - 1 - nth]
    return _rising(column[np.abs(row - column) <= band])


def _bit_rows(a: np.ndarray, b: np.ndarray) -> int:
    """Longest common subsequence, a row of the table as the bits of one integer."""
    full = (1 << len(b)) - 1
    known: dict[int, int] = {}
    left = full
    for x in a.tolist():
        at = known.get(x)
        if at is None:
            at = int.from_bytes(np.packbits(b == x, bitorder="little").tobytes(), "little")
            if len(known) * len(b) < 8 * ROWS:
                known[x] = at
        hit = left & at
        left = (left + hit | left - hit) & full
    return len(b) - left.bit_count()


def _verify(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [matches(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similar) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.bool_())], ["a", "b", "linked"])

    return run


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """In as many partitions as so many rows need, so that few links are few files."""
    return df.coalesce(max(1, -(-rows // LINKS)))


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(id, class) of every id in links (a, b): the smallest id it is connected with.

    before: classes found earlier, with which the links go on. Labels spread over
    links and then jump to their label's label.
    """
    if before is not None:
        links = links.unionByName(before.where("id != class").select(F.col("id").alias("a"), F.col("class").alias("b")))
    rows = 2 * links.count()
    links = _dealt(links, rows)
    both = links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))).distinct()
    both = checkpointed(_dealt(both, rows))
    label = checkpointed(_dealt(both.groupBy("id").agg(F.least(F.min("other"), F.col("id")).alias("class")), rows))
    while True:
        told = both.join(label, "id").select(F.col("other").alias("id"), "class", F.lit(None).cast("long").alias("old"))
        heard = told.unionByName(label.select("id", "class", F.col("class").alias("old"))).groupBy("id").agg(F.min("class").alias("class"), F.max("old").alias("old"))
        jump = label.select(F.col("id").alias("class"), F.col("class").alias("far"))
        new = checkpointed(_dealt(heard.join(jump, "class", "left").select("id", F.least("class", F.coalesce("far", "class")).alias("class"), "old"), rows))
        label = new.select("id", "class")
        if not new.where("class != old").limit(1).count():
            return label


def _values(column: pa.Array, row: int, kind) -> np.ndarray:
    """The numbers of one row's list; of a list of lists or byte strings of one size, theirs."""
    flat = column[row].values
    if pa.types.is_list(flat.type):
        flat = flat.flatten()
    return np.frombuffer(b"".join(flat.to_pylist()), kind) if pa.types.is_binary(flat.type) else np.asarray(flat)


def _pairs(similar: float, sketches: int, best: bool):
    """Pairs of two chunks' members that no bound rules out, each in the first sketch bucket it
    shares; with ``best`` for each member the one pair whose signatures are closest."""
    apart = (1 - similar) / (1 + similar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                key = batch.column("key")[row].as_py()
                same = batch.column("cx")[row].as_py() == batch.column("cy")[row].as_py()
                side = []
                for name in ("x", "y"):
                    chunk = batch.column(name)
                    get = lambda field, kind, chunk=chunk: _values(pc.struct_field(chunk, field), row, kind)  # noqa: E731, B023
                    ids = get("id", np.int64)
                    side.append((ids, get("class", np.int64), get("length", np.int64).astype(np.int64), get("sig", np.uint64).reshape(len(ids), -1), get("keys", np.int64).reshape(len(ids), sketches)))
                    if same:
                        side.append(side[0])
                        break
                (ix, cx, nx, sx, kx), (iy, cy, ny, sy, ky) = side
                found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for lo in range(0, len(ix), 128):
                    here = slice(lo, lo + 128)
                    total = nx[here, None] + ny[None, :]
                    may = (cx[here, None] != cy[None, :]) & (np.minimum(nx[here, None], ny[None, :]) * (1 + similar) >= similar * total - 1e-6)
                    if same:
                        may &= np.arange(lo, lo + len(total))[:, None] < np.arange(len(iy))[None, :]
                    i, j = np.nonzero(may)
                    far = np.bitwise_count(sx[here][i] ^ sy[j]).sum(axis=1, dtype=np.int64)
                    near = far <= apart * total[i, j] + 1e-6
                    i, j, far = i[near] + lo, j[near], far[near] / total[i[near], j[near]]
                    equal = kx[i] == ky[j]
                    own = kx[i, equal.argmax(axis=1)] == key
                    # A bucket of another kind than these sketches' has each pair; repeats go later.
                    own |= ~(kx[i] == key).any(axis=1) | ~equal.any(axis=1)
                    found.append((i[own], j[own], far[own]))
                i, j, far = (np.concatenate(c) for c in zip(*found, strict=True))
                if best:
                    one, two = np.concatenate([ix[i], iy[j]]), np.concatenate([iy[j], ix[i]])
                    far = np.concatenate([far, far])
                    order = np.lexsort((two, far, one))
                    first = np.unique(one[order], return_index=True)[1]
                    one, two, far = one[order][first], two[order][first], far[order][first]
                else:
                    one, two = np.minimum(ix[i], iy[j]), np.maximum(ix[i], iy[j])
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(far)], ["a", "b", "far"])

    return run


def near_duplicates(docs: DataFrame, similar: float = SIMILAR, shingle: int = SHINGLE, sketches: int = SKETCHES, size: int = TUPLE) -> DataFrame:
    """Per row of (doc_id, text): doc_id, class_id."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id is not null and text is not null")
    drawn = checkpointed(map_texts(known.select("doc_id", "text", F.md5("text").alias("print")), _emit_sketches(shingle, sketches, size), "doc_id long, print string, keys array<long>"))
    files = spread(docs.sparkSession, drawn.count(), FILE_ROWS)
    first = drawn.groupBy("print").agg(F.min("doc_id").alias("first"))
    member = drawn.select("doc_id", "print").join(first, "print").select("doc_id", "first")
    one = drawn.join(first.select("print", F.col("first").alias("doc_id")), ["print", "doc_id"]).select(F.col("doc_id").alias("id"), "keys")
    rows = one.select("id", F.explode("keys").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    bucket = checkpointed(rows.join(shared, "key").coalesce(files))
    needed = bucket.select(F.col("id").alias("doc_id")).distinct()
    seqs = map_texts(known.join(needed, "doc_id"), _emit_sequences(shingle), "doc_id long, seq binary, length int, sig binary").withColumnRenamed("doc_id", "id")
    items = checkpointed(seqs.join(one.select("id", F.slice("keys", 1, sketches).alias("keys")), "id").dropDuplicates(["id"]).coalesce(files))

    def verified(pairs: DataFrame) -> DataFrame:
        wide = pairs.join(items.select(F.col("id").alias("a"), F.col("seq").alias("sa")), "a").join(items.select(F.col("id").alias("b"), F.col("seq").alias("sb")), "b")
        return checkpointed(map_texts(wide.select("a", "b", "sa", "sb"), _verify(similar), "a long, b long, linked boolean").where("linked").select("a", "b").coalesce(files))

    links = verified(bucket.where("id != pivot").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct())
    label = components(links)

    def mixed() -> DataFrame:
        state = bucket.join(label, "id", "left").select("key", "n", "id", F.coalesce("class", "id").alias("class"))
        open_ = state.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo != hi").select("key")
        return checkpointed(state.join(open_, "key").coalesce(files))

    def left(best: bool) -> DataFrame:
        """Pairs that are left in buckets of several classes, chunk by chunk."""
        state = mixed().join(items.drop("seq"), "id")
        chunk = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / CHUNK))
        parts = checkpointed(state.groupBy("key", "n", chunk.alias("chunk")).agg(F.collect_list(F.struct("id", "class", "length", "sig", "keys")).alias("m")).coalesce(files))
        parts = parts.select("key", "n", "chunk", F.struct(*(F.col(f"m.{c}").alias(c) for c in ("id", "class", "length", "sig", "keys"))).alias("m"))
        x = parts.select("key", "n", F.col("chunk").alias("cx"), F.col("m").alias("x"))
        y = parts.select("key", F.col("chunk").alias("cy"), F.col("m").alias("y"))
        met = x.where(F.col("n") > CHUNK).join(y, "key").where("cx <= cy").select("key", "cx", "cy", "x", "y")
        alone = x.where(F.col("n") <= CHUNK).select("key", "cx", F.col("cx").alias("cy"), "x", F.lit(None).cast(x.schema["x"].dataType).alias("y"))
        return met.unionByName(alone).mapInArrow(_pairs(similar, sketches, best), "a long, b long, far double")

    best = left(True).groupBy("a").agg(F.min_by("b", F.struct("far", "b")).alias("b"))
    more = verified(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    label = components(more, label)
    label = components(verified(left(False).select("a", "b").distinct()), label)
    classes = member.join(label.withColumnRenamed("id", "first"), "first", "left").groupBy("doc_id").agg(F.min(F.coalesce("class", "first")).alias("class_id"))
    return docs.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def op3_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every ``documents`` text."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
