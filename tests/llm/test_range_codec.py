"""The range coder: damage, large ids, and its size beside zlib's."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from gablework.llm import range_codec
from gablework.llm.bpe import codec


def text_ids(n_words, seed=1):
    """Ids of invented prose: words by a power law, often following the same word."""
    rng = random.Random(seed)
    parts = ["lo", "mi", "ra", "tu", "pe", "ken", "dor", "vas", "li", "el", "on", "um"]
    words = ["".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(4000)]
    follows = {w: rng.choices(words, k=3) for w in words}
    out, w = [], words[0]
    for _ in range(n_words):
        w = rng.choice(follows[w]) if rng.random() < 0.4 else words[min(3999, int(rng.paretovariate(0.7)))]
        out.append(w)
    (ids,) = codec(public_tokenizers.path("byte_bpe_50k.json")).encode([" ".join(out)])
    return np.frombuffer(ids, dtype="<u4")


def test_fewer_bytes_than_zlib_in_blocks_of_the_same_size():
    ids = text_ids(60_000)
    assert len(ids) > 8 * range_codec.BLOCK
    packed, plain = range_codec.pack(ids), ids.astype("<u2")
    assert (range_codec.unpack(packed) == ids).all()
    assert len(packed) < sum(len(zlib.compress(plain[i : i + range_codec.BLOCK].tobytes(), 6)) for i in range(0, len(ids), range_codec.BLOCK))


def test_any_changed_byte_is_a_value_error():
    ids, rng = text_ids(400), random.Random(3)
    packed = range_codec.pack(ids)
    for at in {*range(40), *rng.sample(range(len(packed)), 200)}:
        broken = bytearray(packed)
        broken[at] ^= 1 << rng.randrange(8)
        try:
            assert (range_codec.unpack(bytes(broken)) == ids).all()
        except ValueError:
            pass


def test_any_cut_is_a_value_error():
    packed = range_codec.pack(text_ids(300))
    for n in (*range(0, 60), *range(60, len(packed), 37)):
        with pytest.raises(ValueError):
            range_codec.unpack(packed[:n])


@pytest.mark.parametrize("top", [70_000, 1 << 24, 2**32 - 1])
def test_large_ids(top):
    ids = np.random.default_rng(1).zipf(1.3, 3 * range_codec.BLOCK + 5) % top
    ids[::7] = top
    assert (range_codec.unpack(range_codec.pack(ids)) == ids).all()


def test_one_id_costs_next_to_nothing():
    packed = range_codec.pack(np.zeros(10 * range_codec.BLOCK, dtype=np.int64))
    assert len(packed) < 1500 and not range_codec.unpack(packed).any()
