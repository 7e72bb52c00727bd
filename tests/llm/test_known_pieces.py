"""Pieces that the encoder of columns knows from before: dropped, kept and asked for once."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random

import numpy as np
import public_tokenizers
import pytest

from gablework.llm import bpe

JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("most", [0, 30, 300, 1_000_000])
def test_ids_stay_the_librarys_when_pieces_are_dropped(most, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PIECES", most)
    rng, own = random.Random(most), bpe.ByteBpe(JSON)
    words = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 14))) for _ in range(400)] + ["x" * 200, "Ω12", "a\n", "é\n\n", "12", "'s"]
    for _ in range(12):
        texts = [" ".join(rng.choices(words, k=rng.randrange(12))) for _ in range(40)]
        ((flat, counts),) = own.encode_cut([own.cut(texts)])
        expected = own._tokenizer().encode_batch(texts, add_special_tokens=False)
        assert [x.tolist() for x in np.split(flat, np.cumsum(counts))[:-1]] == [e.ids for e in expected]
        held = own._encoder()
        assert len(held.known) == len(held.counts) == len(held.starts) and len(held.flat) == held.counts.sum()
        assert max(map(len, held.known), default=0) <= bpe.CACHE_PIECE_CHARS


def test_known_pieces_are_not_asked_for_again(monkeypatch):
    own, asked = bpe.ByteBpe(JSON), []
    ask = bpe.PieceEncoder._asked
    monkeypatch.setattr(bpe.PieceEncoder, "_asked", lambda self, texts: asked.extend(texts) or ask(self, texts))
    for texts in (["one word, one"], [" word one", "two word"]):
        list(own.encode_cut([own.cut(texts)]))
    assert sorted("".join(asked)) == sorted("one word, onetwo")


def test_words_are_told_from_other_pieces_as_pythons_pattern_does():
    import re

    import pyarrow as pa
    import pyarrow.compute as pc

    given = ["", " ", " a", " a\n", " É×", " Àß", " a b", "a", " ɐ", " ɏ", " ́", " a1", "\n a", " é "]
    found = pc.match_substring_regex(pa.array(given), bpe._WORD).to_pylist()
    assert found == [bool(re.fullmatch(" [A-Za-zÀ-ÖØ-öø-ɏ]+", x)) for x in given]
