"""Operator 9's words against the whole tokenizer: the same ids, for a share of its work and in bounded memory."""

import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from daybook.llm import packing


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(packing.tokenizer_path())


class Refused:
    def __getattr__(self, name):
        raise AssertionError("plain words need the tokenizer's model only")


def test_plain_words_never_go_through_the_whole_tokenizer(whole):
    words = packing.Words(packing.tokenizer_path())
    words._tokenizer = Refused()
    for text in ("Les élèves, déjà; it's 1984!!! \t\n a.b@c.org WE'LL're $$$ x²½", "Привет, мир — “so” … naïve", " ".join(f"w{i}x{i * 7919}" for i in range(500))):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_are_those_of_the_whole_tokenizer(whole):
    words, rng = packing.Words(packing.tokenizer_path()), random.Random(9)
    odd = [*" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0  　''sStTrRvVmMlLdDeE.,<|>İΣσςJ̌́KÅẞﬁ中文😀​﻿٣\x00\x7f\x80한", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>"]
    texts = [f"a{c}b {c}{c} 1{c}'s '{c}S{c}'LL e{c}́ {c}中" for c in packing.PLAIN]
    texts += ["".join(rng.choices(packing.PLAIN * 2 + odd * 6, k=rng.randrange(30))) for _ in range(4000)]
    for text in [*texts, "", "x" * 5000, "中" * 3000]:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_words_held_are_bounded_by_bytes(whole, monkeypatch):
    monkeypatch.setattr(packing, "BYTES_HELD", 20_000)
    words = packing.Words(packing.tokenizer_path())
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.choice([4, 9, 3000]))) for _ in range(20))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
        assert sum(len(w) + len(ids) for w, ids in words.items()) <= 20_000
