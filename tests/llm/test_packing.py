import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from assayforge.llm.packing import encoder, pack, plan
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_is_the_library():
    code, library = encoder(PATH).encode, Tokenizer.from_file(PATH)
    odd = ["", " ", "  a  b \n\n c", "tab\tx  y", "it's <|endoftext|> so<|endoftext|>", "漢字 😀\x1c z", " lead", "trail ", "a\r\n b"]
    for text in odd + [t or "" for _, t in cases.documents()]:
        assert np.frombuffer(code(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("size", [16, 64, 1024])
def test_packs_whole(spark, size):
    rows = cases.documents()
    got = pack(cases.table(spark, rows), PATH, size).collect()
    by_doc, by_sequence = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = 0
    for i, text in rows:
        ids = ids_of(text)
        total += len(ids)
        at = 0
        for k, r in enumerate(sorted(by_doc[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["length"] == size or k == 0 and r["length"] <= size
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(by_sequence) <= 1.3 * -(-total // size) + 1


def test_empty_and_repeated(spark):
    assert pack(cases.empty(spark), PATH).count() == 0
    got = pack(cases.table(spark, [(1, "a"), (1, "a"), (None, None)]), PATH).collect()
    assert len(got) == 3 and len({(r["sequence_id"], r["offset"]) for r in got}) == 3


def optimum(sizes, room):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins) if b >= sizes[i]}.values():
            bins[k] -= sizes[i]
            place(i + 1, bins)
            bins[k] += sizes[i]
        place(i + 1, [*bins, room - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    place(0, [])
    return best


def test_plan_against_optimum():
    rng = np.random.default_rng(4)
    extra = 0
    for _ in range(60):
        room = int(rng.integers(5, 30))
        sizes = rng.integers(1, room + 1, int(rng.integers(1, 9))).tolist()
        count = {s: sizes.count(s) for s in set(sizes)}
        found = plan(count, room)
        used = {}
        for items, times in found:
            assert sum(items) <= room and times > 0
            for s in items:
                used[s] = used.get(s, 0) + times
        assert used == count
        extra += sum(t for _, t in found) - optimum(sizes, room)
    assert extra <= 2
