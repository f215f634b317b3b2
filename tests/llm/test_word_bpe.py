import random
from hashlib import sha256

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from assayforge.llm.word_bpe import decode, encode, round_trip_digests, word_bpe
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def want(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcXYZ éÉßΣσİ 12٣'stre,.!<|>\n\t ́\x1c漢😀", max_size=40))
def test_encodes_as_the_library(text):
    ids, text_back = want(text)
    assert word_bpe(PATH).encode(text) == ids
    assert word_bpe(PATH).decode(ids) == text_back


def test_every_character_below_20000():
    points = [c for c in range(0x20000) if not 0xD800 <= c < 0xE000]
    texts = [f"ab{chr(c)}cd 1{chr(c)} {chr(c)}x" for c in points]
    bpe = word_bpe(PATH)
    found = LIBRARY.encode_batch(texts, add_special_tokens=False)
    assert [hex(c) for c, t, e in zip(points, texts, found, strict=True) if bpe.encode(t) != e.ids] == []


def test_random_mixed_text():
    rng = random.Random(9)
    blocks = [(0x20, 0x250), (0x370, 0x600), (0x590, 0x700), (0x900, 0xE00), (0x1AB0, 0x1B00), (0x1D00, 0x2C00), (0xA640, 0xABF0), (0x10000, 0x1FBFF)]
    texts = ["".join(chr(rng.randint(*rng.choice(blocks))) for _ in range(rng.randint(1, 24))) for _ in range(4000)]
    bpe = word_bpe(PATH)
    assert [t for t, e in zip(texts, LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True) if bpe.encode(t) != e.ids] == []


def test_special_tokens():
    text = "a<|endoftext|> It's <|startoftext|>"
    assert word_bpe(PATH).encode(text) == want(text)[0]


def test_table(spark):
    rows = cases.documents()
    got = {r["doc_id"]: r for r in round_trip_digests(cases.table(spark, rows), PATH).collect()}
    for i, text in rows:
        ids, back = want(text)
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == sha256(back.encode()).hexdigest()


def test_encode_then_decode(spark):
    rows = [(1, "Hello there"), (2, None), (3, "")]
    got = {r["doc_id"]: r["text"] for r in decode(encode(cases.table(spark, rows), PATH), PATH).collect()}
    assert got == {i: want(t)[1] for i, t in rows}
    assert encode(cases.empty(spark), PATH).count() == 0
