"""Removal of passages that repeat earlier text, word for word.

A window is ``window`` consecutive words of one document. A word is removed if
some window over it has a word sequence that also starts earlier: in a document
with a smaller id, or earlier in the same one.

1. Of each window one anchor is chosen by content alone (the phrase of
   ``phrase`` words with the smallest hash in it), so equal windows have equal
   anchors and about one word in seven starts an anchor.
2. A phrase is written in 16-bit symbols, one a word. Phrases that occur twice in
   the corpus are confirmed by a counting aggregation with map-side combine.
3. Confirmed phrases are dealt out to the shards of text that need them, as symbols
   and without places. A shard is about a megabyte of whole texts; its phrases are
   compiled into an Aho-Corasick automaton, all its texts are streamed through it,
   and its hits are the only source of occurrences.
4. Only windows whose anchor was hit are hashed and shuffled; the smallest
   document of each window hash is again an aggregation with map-side combine.
   A document keeps what it owns and drops the rest.

Exact copies of a text take part once, through their smallest id: a later copy
of at least ``window`` words is removed whole. No step holds a group of equal
keys in one task: hot phrases collapse before the shuffle, and the one join on
phrases is a sort-merge join whose skewed partitions Spark splits.

Windows are told apart by 64-bit hashes of 64-bit word hashes. Words that share a
symbol can only add windows to be hashed, and these are still told apart.

Defined cases: null and empty texts have no words and lose none; texts shorter
than a window lose none; rows that share a doc_id count as one document and are
all returned; rows without a doc_id take no part and keep all words; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayforge.llm import textvec as tv
from assayforge.llm.common import map_texts

WINDOW = 20
PHRASE = 8


def anchors(words: tv.Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of whole windows, word index of each one's anchor, phrase hashes)."""
    grams = words.windows(phrase)
    starts = np.flatnonzero(words.whole(window))
    if not len(starts):
        return starts, starts, grams
    per = window - phrase + 1
    best = np.lib.stride_tricks.sliding_window_view(grams, per).argmin(axis=1)
    return starts, starts + best[starts], grams


def keys_of(words: tv.Words, at: np.ndarray, phrase: int) -> np.ndarray:
    """The phrases that start at these words: rows of longs, four symbols in each."""
    symbols = np.zeros((len(at), 4 * width(phrase)), "<u2")
    symbols[:, :phrase] = (words.hash >> np.uint64(48)).astype("<u2")[at[:, None] + np.arange(phrase)]
    return symbols.view("<i8")


def key_names(phrase: int) -> list[str]:
    return [f"key_{i}" for i in range(width(phrase))]


def width(phrase: int) -> int:
    """Longs that hold a phrase."""
    return -(-phrase // 4)


def spelled(symbols: np.ndarray) -> str:
    """Symbols as characters, beyond the range that has surrogates."""
    return (symbols.astype("<u4") + 0x10000).tobytes().decode("utf-32-le")


def located(words: tv.Words, phrase: int, keys: np.ndarray) -> np.ndarray:
    """Which words start a phrase of this shard, by its automaton over all its texts.

    keys: the shard's confirmed phrases as ``keys_of`` writes them; repeats are allowed.
    """
    out = np.zeros(len(words.hash), bool)
    if not len(keys) or not len(out):
        return out
    listed = spelled(np.ascontiguousarray(keys, "<i8").view("<u2")[:, :phrase])
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for one in {listed[i : i + phrase] for i in range(0, len(listed), phrase)}:
        automaton.add_word(one)
    automaton.make_automaton()
    ends = [end for end, _ in automaton.iter(spelled(words.hash >> np.uint64(48)))]
    out[np.asarray(ends, np.int64) - phrase + 1] = True
    # Texts follow each other in the stream without a gap.
    return out & words.whole(phrase)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column; null as empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    off = np.concatenate([[0], np.cumsum(sizes)])
    return off, np.asarray(column.flatten())


def _emit_phrases(window: int, phrase: int, by_doc: bool):
    names = key_names(phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("first"))
            ids = np.asarray(batch.column("doc_id"))
            for words in tv.words_of(batch.column("text")):
                _, at, grams = anchors(words, window, phrase)
                at = np.unique(at)
                if not len(at):
                    continue
                doc = words.doc_of()[at]
                # Once a shard to be counted, once a document to be dealt out.
                told = grams[at] if not by_doc else _tagged(grams[at], doc)
                _, once, n = np.unique(told, return_index=True, return_counts=True)
                last = n.astype(np.int64) if not by_doc else ids[words.rows[0] + doc[once]]
                keys = keys_of(words, at[once], phrase)
                yield pa.RecordBatch.from_arrays([*(pa.array(k) for k in keys.T.copy()), pa.array(last)], [*names, "doc_id" if by_doc else "n"])

    return run


def _phrases(column: pa.Array, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and keys of the lists of phrases; null as empty."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
    flat = column.flatten()
    keys = np.stack([np.asarray(flat.field(name)) for name in names], axis=1) if len(flat) else np.zeros((0, len(names)), np.int64)
    return np.concatenate([[0], np.cumsum(sizes)]), keys


def _candidates(words: tv.Words, off: np.ndarray, keys: np.ndarray, known: np.ndarray, window: int, phrase: int):
    """(window starts whose anchor the automaton hit, their hashes); only texts with an id take part."""
    lo, hi = words.rows
    hit = located(words, phrase, keys[off[lo] : off[hi]])
    if not hit.any():
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64)
    starts, anchor, _ = anchors(words, window, phrase)
    starts = starts[hit[anchor] & known[lo:hi][words.doc_of()[starts]]]
    return starts, words.windows(window)[starts]


def _tagged(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix(hashes + doc.astype(np.uint64) * np.uint64(tv.BYTE_BASE))


def _emit_windows(window: int, phrase: int):
    names = key_names(phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column("first"))
            ids = np.asarray(batch.column("doc_id"))
            off, keys = _phrases(batch.column("phrases"), names)
            known = np.ones(len(ids), bool)
            for words in tv.words_of(batch.column("text")):
                starts, hashes = _candidates(words, off, keys, known, window, phrase)
                if not len(starts):
                    continue
                doc = words.doc_of()[starts]
                once = np.unique(_tagged(hashes, doc), return_index=True)[1]
                yield pa.RecordBatch.from_arrays([tv.signed(hashes[once]), ids[words.rows[0] + doc[once]]], ["win", "doc_id"])

    return run


def kept_text(words: tv.Words, removed: np.ndarray) -> list[bytes]:
    """Of each text, its kept words joined by one space."""
    keep = np.flatnonzero(~removed)
    size = words.end[keep] - words.start[keep] + 1
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
    if len(keep):
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        source = np.arange(len(out)) + np.repeat(words.start[keep] - (ends - size), size)
        out[inside] = words.buf[source[inside]]
    raw = out.tobytes()
    cut = np.concatenate([[0], ends])[np.searchsorted(keep, words.first)]
    return [raw[a : max(a, b - 1)] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _emit_kept(window: int, phrase: int, as_is: bool, more: int):
    names = key_names(phrase)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, keys = _phrases(batch.column("phrases"), names)
            known = np.asarray(batch.column("doc_id").is_valid())
            own_off, own = _lists(batch.column("owned"))
            copy = np.asarray(batch.column("later_copy"))
            for words in tv.words_of(batch.column("text")):
                lo, hi = words.rows
                starts, hashes = _candidates(words, off, keys, known, window, phrase)
                count = np.diff(words.first)
                removed = np.repeat(copy[lo:hi] & (count >= window), count)
                if len(starts):
                    doc = words.doc_of()[starts]
                    tags = _tagged(hashes, doc)
                    mine = own[own_off[lo] : own_off[hi]].astype(np.int64).view(np.uint64)
                    owner = np.repeat(np.arange(hi - lo), np.diff(own_off[lo : hi + 1]))
                    stays = np.zeros(len(starts), bool)
                    stays[np.unique(tags, return_index=True)[1]] = True
                    stays &= np.isin(tags, _tagged(mine, owner))
                    edge = np.zeros(len(removed) + 1, np.int64)
                    np.add.at(edge, starts[~stays], 1)
                    np.add.at(edge, starts[~stays] + window, -1)
                    removed |= np.cumsum(edge[:-1]) > 0
                gone = np.diff(np.concatenate([[0], np.cumsum(removed)])[words.first])
                kept = pa.array(kept_text(words, removed), pa.binary()).cast(pa.string())
                if as_is:
                    kept = pc.if_else(pa.array(gone > 0), kept, batch.column("text").slice(lo, hi - lo).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(count.astype(np.int64)),
                        pa.array(gone.astype(np.int64)),
                        kept,
                        *(batch.column(f"more_{i}").slice(lo, hi - lo) for i in range(more)),
                    ],
                    ["doc_id", "n_words", "n_removed", "kept_text", *(f"more_{i}" for i in range(more))],
                )

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, as_is: bool = False, more: tuple[str, ...] = ()) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_text.

    kept_text has the kept words joined by one space; with ``as_is`` a text that
    loses nothing stays as it was. more: columns that are passed on.
    """
    if not 1 <= phrase <= window:
        raise ValueError("phrase must have 1 to window words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(c).alias(f"more_{i}") for i, c in enumerate(more)))
    kinds = "".join(f", {f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name.startswith("more_"))
    passed = [f"more_{i}" for i in range(len(more))]
    prints = docs.select("doc_id", F.md5("text").alias("print")).where("print is not null")
    first = prints.groupBy("print").agg(F.min("doc_id").alias("doc_id"))
    # The whole text is dealt out by doc_id once, and the four passes below reuse that
    # exchange; they filter in the pass itself, as a filter that moves below the join
    # would make each exchange one of its own.
    base = docs.join(first.select("doc_id", F.lit(True).alias("first")).distinct(), "doc_id", "left")
    base = base.select("doc_id", "text", F.coalesce("first", F.lit(False)).alias("first"), *passed)

    keys = key_names(phrase)
    typed = "".join(f"{k} long, " for k in keys)
    counted = map_texts(base, _emit_phrases(window, phrase, False), typed + "n long")
    confirmed = counted.groupBy(*keys).agg(F.sum("n").alias("n")).where("n >= 2")
    # Not the grouping columns themselves: the join then has an exchange on both sides,
    # and partitions with hot phrases can be split.
    confirmed = confirmed.select(*(F.col(k).bitwiseXOR(F.lit(0).cast("long")).alias(k) for k in keys))
    wanted = map_texts(base, _emit_phrases(window, phrase, True), typed + "doc_id long")
    phrases = wanted.join(confirmed.hint("merge"), keys).groupBy("doc_id").agg(F.collect_list(F.struct(*keys)).alias("phrases"))

    known = base.join(phrases, "doc_id", "left")
    windows = map_texts(known, _emit_windows(window, phrase), "win long, doc_id long")
    owned = windows.groupBy("win").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.collect_list("win").alias("owned"))
    ready = known.join(owned, "doc_id", "left").select("doc_id", "text", "phrases", "owned", *passed, (~F.col("first") & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).alias("later_copy"))
    out = map_texts(ready, _emit_kept(window, phrase, as_is, len(more)), "doc_id long, n_words long, n_removed long, kept_text string" + kinds)
    return out.withColumnsRenamed(dict(zip(passed, more, strict=True)))


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``, 20-word windows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
