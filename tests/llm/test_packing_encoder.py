"""Op 7 encodes a text by one call of the rank table, whatever its words, with the ids of the tokenizer itself."""
import random

import numpy as np
import public_tokenizers
import pytest

from actuaria.llm import packing


@pytest.fixture(scope="module")
def enc():
    return packing.Encoder(public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(packing.RANKS))


def ids(enc, text):
    return np.frombuffer(enc.ids(text), "<u4").tolist()


def test_ids_are_those_of_the_tokenizer(enc):
    r = random.Random(5)
    parts = [" ", "\n", "a", "B", "'s", "'", "é", "漢", "1", "²", ".", "!!", "\t", " ", "\u0085", "\x1c", "the", "́", "<|", "<|endoftext|>"]
    for k in range(4000):
        some = parts[:12] if k % 2 else parts
        text = "".join(r.choice(some) for _ in range(r.randint(0, 20)))
        assert ids(enc, text) == enc.whole(text), text
    for text in ("", " ", "\n", " a", "a ", "a  b", "a\n\nb", "a \n b", "one two\nthree", "x <|endoftext|> y", "f <| g"):
        assert ids(enc, text) == enc.whole(text), text


def test_a_text_is_one_call_whatever_its_words(enc, monkeypatch):
    """Words that occur once cost no call each, and nothing is kept from text to text."""
    calls = []
    for name in ("plain", "apart", "whole"):
        monkeypatch.setattr(enc, name, lambda text, run=getattr(enc, name, None), name=name: calls.append(name) or run(text), raising=False)
    ids(enc, " ".join(f"w{i}x{i * 7919}" for i in range(3000)) + ".\nNext line")
    ids(enc, "two  blanks and words " * 50)
    ids(enc, "a\ttab")
    assert calls == ["apart", "plain", "whole"]
