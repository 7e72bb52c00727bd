"""Near copies against the exact Jaccard similarity of their shingle sets."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pytest

from gablework.llm import near_copies, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)


def jaccard(a, b):
    a, b = (set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for t in (a, b))
    return len(a & b) / len(a | b)


def at_similarity(seed, changed, n=200):
    """Two texts of n words; the second has its last so many words changed."""
    words = random.Random(seed).choices([f"w{i}" for i in range(5000)], k=n)
    return " ".join(words), " ".join([*words[: n - changed], *(f"z{seed}x{i}" for i in range(changed))])


def brute(texts):
    """The smallest position that each reaches over similarities of 0.8 or more."""
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if jaccard(texts[i], texts[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_clean_documents_below_the_limit_stay(spark):
    pairs = [at_similarity(s, 26) for s in range(60)]
    assert all(0.7 < jaccard(*p) < 0.8 for p in pairs)
    assert simhash.kept_documents(frame(spark, [t for p in pairs for t in p])).count() == 120


@pytest.mark.parametrize("rows", [512, 3], ids=["one", "tiled"])
def test_groups_equal_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(near_copies, "TILE_ROWS", rows)
    rng, base = random.Random(2), at_similarity(0, 1)[0].split()
    texts = []
    for i in range(60):  # one large group of near copies, some beyond the limit
        t = list(base)
        for _ in range(3 * (i % 5)):
            t[rng.randrange(len(t))] = f"q{i}x{rng.random()}"
        texts.append(" ".join(t))
    docs = frame(spark, texts)
    of, nodes = simhash._nodes(docs, simhash.SIMILAR)
    roots = near_copies.verified(docs, nodes, nodes.selectExpr("node", "1L as root"), 5)
    root, node = {r.node: r.root for r in roots.collect()}, {r.doc_id: r.node for r in of.collect()}
    own = [root.get(node[i], node[i]) for i in range(60)]
    exact = brute(texts)
    assert len(set(exact)) > 1
    assert all((own[i] == own[j]) == (exact[i] == exact[j]) for i in range(60) for j in range(i))


def test_limit_is_exact():
    a = np.arange(9, dtype=np.uint64)
    assert near_copies.near_pairs([a[:8], a[:8] + np.uint64(1)]) == []  # 7 of 9
    assert near_copies.near_pairs([a[:4], a[:5]]) == [(0, 1)]  # 4 of 5
    assert near_copies.near_pairs([a[:0], a[:5]]) == []


def test_near_copies_at_the_limit_go(spark):
    pairs = [at_similarity(s, 21) for s in range(150)]
    assert all(0.8 <= jaccard(*p) < 0.82 for p in pairs)
    assert {r.doc_id for r in simhash.kept_documents(frame(spark, [t for p in pairs for t in p])).collect()} == set(range(0, 300, 2))


def test_sketch_bits_follow_similarity():
    rng, far = np.random.default_rng(1), []
    for n in (5, 100, 2000):
        for _ in range(100):
            a = rng.integers(0, 2**64, size=n, dtype=np.uint64)
            far.append(np.bitwise_count(simhash.sketch(a)[0] ^ simhash.sketch(a[: n * 4 // 5])[0]).sum())
    assert 17 < np.mean(far) < 21.5 and max(far) <= simhash.SIMILAR.max_bits
