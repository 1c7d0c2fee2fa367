"""Ids of texts cut into words against the tokenizer's own ids of whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from orrery.llm import packing

PARTS = [
    "abc", "Bata", "coven", "é", "É", "é", "å", "İ", "İstanbul", "Σας", "ΟΔΟΣ", "ς", "ß", "ẞ", "ﬁ", "ÿ", "÷", "ª", "ø", "ñandú", "naïve", "ö", "́", "̸",
    ".", ",", "!!", "?", "…", "'s", "'re", "'", "’s", "don't", "\"", "(", ")", "-", "_", "#", "$", "%", "|", "*", ":", ";", "=", "<", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
    "1", "42", "½", "²", "Ⅷ", "٣", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "\x1c", "\x85", " ", " ", "​", "﻿", "\x00", "你好", "日本", "한국", "각", "🙂", "👩‍👩", "क्षि", "ไทย",
]


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(public_tokenizers.path("word_bpe_49k.json"))


def check(tokens, texts):
    ids, sizes = tokens.encode(pa.array(texts, pa.string()))
    want = [tokens.encoder.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sizes.tolist() == list(map(len, want))
    for text, got, ids_ in zip(texts, np.split(ids, np.cumsum(sizes)[:-1]), want, strict=True):
        assert got.tolist() == ids_, repr(text)


def test_errors_that_cancel(tokens):
    check(tokens, ["é İ", "åb", "İd", "b é İ c", "Σ ΑΣ ας"])


@pytest.mark.parametrize("seed", range(6))
def test_random_texts(tokens, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(PARTS) + " " * (rng.random() < 0.4) for _ in range(rng.randrange(30))) for _ in range(400)]
    check(tokens, [*texts, None, "", " \n", "x" * 5000])
    if seed % 2:
        rows = [chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0x3000), rng.randrange(0x1F000, 0x1FFFF)])) for _ in range(4000)]
        check(tokens, ["".join(rows[k : k + 20]) for k in range(0, 4000, 20)])


def test_store_starts_anew(tokens, monkeypatch):
    monkeypatch.setattr(packing, "STORED_WORDS", 50)
    for a in range(0, 120, 30):
        check(tokens, [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(a, a + 30)), "the wab,"])


def test_files_with_other_splitters():
    plain = packing.Tokens(public_tokenizers.path("byte_bpe_50k.json"))
    assert not plain.by_word
    check(plain, ["Ab  c\n d.", None, "é é"])
