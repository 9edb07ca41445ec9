import random

import numpy as np
import public_tokenizers
import pyarrow as pa

from tessera.llm._tokens import ByteUnits, WordUnits

PIECES = [
    "BİLGİ", "SERGİ.", "DİYARBAKIRLİ,", "Σ", "ΣΑΣ", "ΑΣ.", "i̇", "İ", "İ", "̇", "é", "É", "ß", "ﬁ", "x", "Hello", "don't",
    "'S", "WE'LL", "12", "3.5", "①", "中文", "नमस्ते", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|", "|>", "endoftext", ",", ".", "!?",
    "$5", "#tag", "&amp;", "\t", "\n", "\r", "\x0b", "\x0c", "\x85", "\xa0", " ", "​", "\x00", "\x01", "\x02", "_", "-", "—", "😀", "👍🏽",
    "K", "Å", "ǅ", "ŉ", " ", "  ", "\x1c", "\x1d",
]


def texts(n):
    rng = random.Random(1)
    return ["".join(rng.choice(PIECES) + (" " if rng.random() < 0.4 else "") for _ in range(rng.randrange(0, 9))) for _ in range(n)]


def test_word_units_equal_the_library():
    units, some = WordUnits.of(public_tokenizers.path("word_bpe_49k.json")), texts(15_000)
    for part in (some, ["", ""], []):
        flat, n = units.ids(pa.array(part, pa.string()))
        want = [x.ids for x in units.tokenizer.encode_batch(part, add_special_tokens=False)]
        assert n.tolist() == list(map(len, want))
        assert flat.tolist() == [i for x in want for i in x]


def test_word_units_of_a_slice_and_of_every_letter():
    units = WordUnits.of(public_tokenizers.path("word_bpe_49k.json"))
    some = [chr(c) + ", " + chr(c) + "a." for c in range(0x110000) if not 0xD800 <= c < 0xE000][:: 7]
    flat, n = units.ids(pa.array(["skipped", *some]).slice(1))
    want = [x.ids for x in units.tokenizer.encode_batch(some, add_special_tokens=False)]
    assert n.tolist() == list(map(len, want)) and flat.tolist() == [i for x in want for i in x]


def test_byte_units_equal_the_library():
    units, some = ByteUnits.of(public_tokenizers.path("byte_bpe_50k.json")), texts(15_000)
    assert units.counts(some) == [len(x.ids) for x in units.tokenizer.encode_batch(some, add_special_tokens=False)]


def test_words_forgotten_and_learnt_again(monkeypatch):
    from tessera.llm import _tokens

    monkeypatch.setattr(_tokens, "MAX_UNITS", 50)
    units, some = WordUnits(public_tokenizers.path("word_bpe_49k.json")), texts(200)
    for at in range(0, 200, 10):
        flat, n = units.ids(pa.array(some[at : at + 10]))
        want = [x.ids for x in units.tokenizer.encode_batch(some[at : at + 10], add_special_tokens=False)]
        assert np.array_equal(flat, [i for x in want for i in x])
