"""The range coder's streams: how many steps a segment takes, what streams learn together, sections."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random

import numpy as np
import pytest

from gablework.llm import range_codec


def prose(n, seed=1):
    """n ids that often follow the same id."""
    rng, out = random.Random(seed), [0]
    follows = [rng.choices(range(4000), k=3) for _ in range(4000)]
    while len(out) < n:
        out.append(rng.choice(follows[out[-1]]) if rng.random() < 0.6 else min(3999, int(rng.paretovariate(0.7))))
    return np.array(out)


def test_a_segment_takes_fewer_steps_than_a_block_has_ids(monkeypatch):
    steps, predict = [], range_codec._Model.predict
    monkeypatch.setattr(range_codec._Model, "predict", lambda self, n: steps.append(n) or predict(self, n))
    ids = prose(3 * range_codec.BLOCK + 5)
    packed = range_codec.pack(ids)
    assert sum(steps) == len(ids) and len(steps) <= range_codec.BLOCK // 16
    steps.clear()
    assert (range_codec.unpack(packed) == ids).all()
    assert sum(steps) == len(ids) and len(steps) <= range_codec.BLOCK // 16


def test_blocks_learn_from_each_other():
    rng = np.random.default_rng(3)
    after, ids = rng.permutation(4000), rng.integers(0, 4000, 16 * range_codec.BLOCK)
    for i in np.flatnonzero(rng.random(len(ids) - 1) < 0.7) + 1:
        ids[i] = after[ids[i - 1]]
    table = len(range_codec._Order0.of(ids)[0].packed())
    alone = sum(len(range_codec.pack(ids[i : i + range_codec.BLOCK])) - table for i in range(0, len(ids), range_codec.BLOCK))
    assert len(range_codec.pack(ids)) < 0.8 * alone


def test_what_is_learned_does_not_hang_on_the_order_of_streams():
    rng = np.random.default_rng(2)
    order0, _ = range_codec._Order0.of(np.arange(50))
    rows, order = rng.integers(0, 4, (40, 64)).astype(np.int32), rng.permutation(64)
    one, other = range_codec._Model(64, order0), range_codec._Model(64, order0)
    for now in rows:
        for model, own in ((one, now), (other, now[order])):
            candidate, _ = model.predict(64)
            model.update(64, own, candidate == own)
    assert one.slots.any() and (one.slots == other.slots).all() and (one.p == other.p).all() and (one.weights == other.weights).all()


@pytest.mark.parametrize("n", [1, 255, 256, 257, 8191, 8192, 8193, 16_384, 20_001])
def test_sections_and_odd_lengths(n, monkeypatch):
    monkeypatch.setattr(range_codec, "_SECTION", 8192)
    ids = prose(n)
    packed = range_codec.pack(ids)
    assert (range_codec.unpack(packed) == ids).all()
    first = len(range_codec.pack(ids[:8192]))
    for cut in {first, first - 1, first + 3, len(packed) - 1} & {*range(len(packed))}:
        with pytest.raises(ValueError):
            range_codec.unpack(packed[:cut])
    with pytest.raises(ValueError):
        range_codec.unpack(packed + b"\0")


def test_words_are_a_number_within_the_exact_interval():
    """The streams against intervals in Python's integers of any size, carries and all."""
    ids = prose(3000, seed=4)
    order0, places = range_codec._Order0.of(ids)
    words, counts = range_codec._coded(places, order0)
    grid = [x.tolist() for x in np.split(places, range(256, 3000, 256))]
    streams, total = len(grid), order0.bits
    model, low, width, shift = range_codec._Model(streams, order0), [0] * streams, [(1 << 63) - 1] * streams, [63] * streams
    for step in range(256):
        n = streams if step < len(grid[-1]) else streams - 1
        now = np.array([g[step] for g in grid[:n]], dtype=np.int32)
        candidate, p = model.predict(n)
        for i in range(n):
            cut = (width[i] >> 16) * int(p[i])
            if candidate[i] == now[i]:
                width[i] = cut
            else:
                r = (width[i] - cut) >> total
                low[i] += cut + r * int(order0.start[now[i]])
                width[i] = r * int(order0.freq[now[i]])
            if width[i] < 1 << 31:
                low[i], width[i], shift[i] = low[i] << 32, width[i] << 32, shift[i] + 32
        model.update(n, now, candidate == now)
    for i, own in enumerate(np.split(words, np.cumsum(counts)[:-1])):
        value = int.from_bytes(own[::-1].tobytes(), "little")
        bits = 32 * len(own)
        assert low[i] << bits <= value << shift[i] < (low[i] + width[i]) << bits
