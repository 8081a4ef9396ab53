import random

import public_tokenizers
import pytest
from strandflow.llm.bpe import CAPITALS, UNKNOWN, BpeCodec, decode, encode, token_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = ["", " ", "Hello,  World! it's 2024", "naïve café", "ΑΣ ΣΑΣ. Σ", "İstanbul", "a" * 5000, "<|endoftext|> x<|startoftext|>y", "<|ENDOFTEXT|>", "a\x1cb \x1f c", "x y z　", "日本語 テスト", "🙂🙂 👍🏽", "don't WE'LL 're 12345", "\t\n\r\x0b\x0c", "#$%^&*!!", "Å", "é ́x"]


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    return BpeCodec(PATH), tokenizers.Tokenizer.from_file(PATH)


def test_cases_equal_the_library(both):
    own, lib = both
    rng = random.Random(5)
    words = ["the", "THE", "onandth,", "ciónadora", "été", "über", "ß", "x1y2", "'s", "--", " ", "Σς"]
    for text in CASES + [" ".join(rng.choices(words, k=40)) for _ in range(50)] + ["".join(chr(rng.randrange(32, 0x2FF)) for _ in range(60)) for _ in range(200)]:
        want = lib.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert list(memoryview(got).cast("I")) == want, text
        assert own.decode(got) == lib.decode(want, skip_special_tokens=False)


def test_rows(spark, both):
    rows = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "Two words", "c"), (3, "Two words", "d")], "doc_id long, text string, ids string")
    got = {(r.doc_id, r.n_tokens) for r in token_digests(rows, PATH).collect()}
    assert got == {(1, 0), (2, 0), (3, 2)}
    assert token_digests(rows.limit(0), PATH).count() == 0


def test_letter_classes_are_the_library_s(both):
    """Every code point to U+1FFFF in steps, and all of those that tables differ about."""
    own, lib = both
    points = [*range(1, 0x20000, 37), *(c for a, b, *_ in [*UNKNOWN[:-2], *CAPITALS] for c in range(a, b + 1)), 0x323B0, 0x33479, 0x3D000, 0x3FC3F]
    for c in points:
        if not 0xD800 <= c < 0xE000:
            text = f"a{chr(c)}1 {chr(c)}"
            assert list(memoryview(own.encode(text)).cast("I")) == lib.encode(text, add_special_tokens=False).ids, hex(c)


def test_encode_then_decode(spark, both):
    own, lib = both
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)] + [(99, None), (0, CASES[0])], "doc_id long, text string")
    encoded = encode(rows, PATH)
    want = {i: lib.encode(t, add_special_tokens=False).ids for i, t in [*enumerate(CASES), (99, "")]}
    assert {r.doc_id: list(memoryview(bytes(r.ids)).cast("I")) for r in encoded.collect()} == want and encoded.count() == len(CASES) + 2
    assert {r.doc_id: r.decoded for r in decode(encoded, PATH).collect()} == {i: lib.decode(ids, skip_special_tokens=False) for i, ids in want.items()}
