"""Encoding and decoding with a word-level BPE vocabulary.

A piece of text starts as a doubly linked list of its byte letters, the last one
marked as the word's end. A priority queue holds each neighbouring pair that can
merge, by rank and then by place; the best one is merged, its new neighbours are
queued, and entries whose symbols have changed meanwhile are skipped when they
come up. Decoding concatenates vocabulary strings (with the separator that the
library uses where a file names no decoder: one space).

Texts with marks or with characters that Python's tables don't know are cut into pieces by the library's own
normaliser and pre-tokeniser, whose tables can be of another Unicode version.

Defined cases: null and empty texts have no ids; strings of special tokens in a
text become their ids, as in the library; a very long text is encoded chunk by chunk
between white space, and only a chunk is ever in the queue. Repeated rows are encoded again; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from assayforge.llm.packing import _byte_letters

#: Chunks and pieces that a worker remembers, of each kind in two generations.
MEMO = 200_000
WORD_END = "</w>"
#: What \s stands for in the file's patterns; str.split() also splits at \x1c-\x1f.
SPACES = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
ODD = re.compile("[\\x1c-\\x1f]")
#: Characters without a class in the tables of ``regex``, and marks, whose order in a cluster is newer than some tables.
UNKNOWN = regex.compile(r"\p{Cn}|(?![\u0300-\u036f])\p{M}")


class _Memo(dict):
    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class WordBpe:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(merges)}
        self.letter = [c for c, _ in sorted(_byte_letters().items(), key=lambda x: x[1])]
        self.byte = {c: b for b, c in enumerate(self.letter)}
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: s for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self._pieces = _Memo(self.merge)
        self._chunks = _Memo(self._shown)

    def merge(self, piece: str) -> list[int]:
        """Ids of one pre-tokenised piece."""
        # A printable ASCII character is its own letter.
        symbol = list(piece) if piece.isascii() and piece.isprintable() else [self.letter[b] for b in piece.encode("utf-8")]
        symbol[-1] += WORD_END
        n = len(symbol)
        if n == 1:
            return [self.vocab[symbol[0]]]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        ranks = self.ranks
        queue = [(ranks[pair], i, *pair) for i, pair in enumerate(zip(symbol, symbol[1:], strict=False)) if pair in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue  # stale
            symbol[i], symbol[j] = a + b, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get((a + b, symbol[k]))) is not None:
                    heapq.heappush(queue, (r, i, a + b, symbol[k]))
            if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], a + b))) is not None:
                heapq.heappush(queue, (r, h, symbol[h], a + b))
        return [self.vocab[s] for s in symbol if s]

    def chunk(self, text: str) -> list[int]:
        """Ids of a text without white space."""
        if max(text) >= "\u0300" and (UNKNOWN.search(text) or any(unicodedata.category(c) == "Cn" for c in text)):
            pieces = self._unknown(text)
        else:
            pieces = self.pieces.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if len(pieces) == 1:
            return self._pieces[pieces[0]]
        return [i for piece in pieces for i in self._pieces[piece]]

    def _unknown(self, text: str) -> list[str]:
        """Pieces of a text with characters that the tables here may not know: the library's do."""
        text = self.library.normalizer.normalize_str(text)
        # Its byte letters back to text: a piece is a run of whole characters.
        return [bytes(self.byte[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _shown(self, chunk: str) -> tuple[str, str] | None:
        """A chunk's ids as decimals and decoded; None if it has none."""
        ids = self.chunk(chunk)
        return (" ".join(map(str, ids)), self.decode(ids)) if ids else None

    def _parts(self, text: str) -> Iterator[tuple[str, str]]:
        """Of each chunk that has ids: these as decimals and decoded."""
        for part in self.cut.split(text) if "<|" in text else (text,):
            if part in self.special:
                yield str(self.special[part]), part
            else:
                words = part.split() if not ODD.search(part) else filter(None, SPACES.split(part))
                yield from filter(None, map(self._chunks.__getitem__, words))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self._parts(text) for i in ids.split(" ")]

    def decode(self, ids) -> str:
        return " ".join(map(self.strings.__getitem__, ids))

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by one space, decoded text)."""
        parts = list(self._parts(text))
        ids = " ".join([p[0] for p in parts])
        return ids.count(" ") + bool(ids), ids, " ".join([p[1] for p in parts])


_loaded: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def _emit(path: str, make, names: list[str], kinds: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            rows = [make(bpe, text or "") for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["doc_id", *names])

    return run


def _docs(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids."""
    return _docs(docs).mapInArrow(_emit(path, lambda bpe, text: (bpe.encode(text),), ["ids"], [pa.list_(pa.int32())]), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            texts = [bpe.decode(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256, without moving ids or texts out of the worker."""
    from hashlib import sha256

    def make(bpe: WordBpe, text: str):
        n, ids, decoded = bpe.round_trip(text)
        return n, sha256(ids.encode()).hexdigest(), sha256(decoded.encode()).hexdigest()

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return _docs(docs).mapInArrow(_emit(path, make, names, [pa.int64(), pa.string(), pa.string()]), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents``."""
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
