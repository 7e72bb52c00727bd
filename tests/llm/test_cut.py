"""Texts cut and encoded by column against the library on whole texts; a segment of one id."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random
import warnings

import numpy as np
import public_tokenizers
import pytest

from gablework.llm import bpe, range_codec

JSON = public_tokenizers.path("byte_bpe_50k.json")
CHARS = list("ab ,.'\n\t  \x1c\x85\xa0é’«​　  \U0001f600中 1éßÄ×÷Ãɏ²½#$_-\"ñ0´йs't") + [" Straße", " word", "'s"]


@pytest.mark.parametrize("extra", [[], ["<|endoftext|>"]])
def test_ids_of_a_column_are_the_librarys(extra):
    rng = random.Random(1)
    texts = ["".join(rng.choices(CHARS + extra, k=rng.randrange(14))) for _ in range(6000)] + ["", " ", "  ", "   a", " of the word"]
    own = bpe.ByteBpe(JSON)
    parts = [texts[:1000], [], texts[1000:]]
    got = [x for flat, counts in own.encode_cut([own.cut(p) for p in parts]) for x in np.split(flat, np.cumsum(counts))[:-1]] if parts else []
    expected = own._tokenizer().encode_batch(texts, add_special_tokens=False)
    assert [g.tolist() for g in got] == [e.ids for e in expected]


def test_a_piece_is_encoded_once_for_many_texts(monkeypatch):
    own, asked = bpe.ByteBpe(JSON), []
    each = bpe.PieceEncoder.each
    monkeypatch.setattr(bpe.PieceEncoder, "each", lambda self, different, sizes: asked.extend(different) or each(self, different, sizes))
    list(own.encode_cut([own.cut(["one word, one"] * 50), own.cut([" word one"] * 50)]))
    assert sorted(asked) == sorted({"one", " word", ",", " one"})


def test_other_patterns_are_cut_at_spaces_alone():
    from tokenizers import Regex, pre_tokenizers

    own = bpe.ByteBpe(JSON)
    own._tokenizer().pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(r"[^\p{L}\p{N}]?\p{L}+|\s+(?!\S)|\s+|."), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    assert own._added() is None and own.cut(["a1,b c"])[0].to_pylist() == ["a1,b", " c"]
    ((flat, _),) = own.encode_cut([own.cut(["a1,b (c) 's word"])])
    assert flat.tolist() == own._tokenizer().encode("a1,b (c) 's word", add_special_tokens=False).ids


def test_a_table_of_one_id_divides_by_nothing_left():
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        packed = range_codec.pack(np.full(20_000, 7))
        assert (range_codec.unpack(packed) == 7).all()
