"""Tokens, counts and numbers of whole columns of text against one text at a time."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import random
from collections import Counter

import numpy as np
import pytest

from gablework.llm import pseudo_likelihood as pl

ODD = ["", "İstanbul Σας ΟΔΟΣ, Σ", "a_b²½ \x1c\x85x​y z", "\U0001f600\U00020000 é ا _", "\n\n", " ", "it's", "\x00a\x00"]


def texts(n=300):
    rng = random.Random(5)
    chars = "abcé ß \n,.'_19²　中\U0001f600́ΣσςİI"
    return ODD + ["".join(rng.choices(chars, k=rng.randrange(80))) for _ in range(n)]


@pytest.mark.parametrize("given", [texts(), [], [""], [" ", ""], ["a"]])
def test_tokens_of_a_column_are_those_of_each_text(given):
    tokens, counts = pl._tokens(given)
    words, ends = tokens.to_pylist(), np.cumsum(counts)
    assert [words[e - n : e] for e, n in zip(ends, counts, strict=True)] == [pl._TOKEN.findall(t.lower()) for t in given]


@pytest.mark.parametrize("held", [True, False])
def test_a_word_is_looked_up_once_and_numbered_as_in_its_text(held, monkeypatch):
    given, own = texts(), pl.Settings(classes=4, buckets=4)
    counts = Counter(w for t in given for w in pl._TOKEN.findall(t.lower()))
    vocabulary = pl.Vocabulary([w for w, _ in counts.most_common(own.vocabulary - own.buckets)], own)
    often = [w for w, n in counts.items() if n > 1 and w not in vocabulary]
    hashes = pl.hashes_of(often)
    order = np.argsort(hashes)
    shares = pl.Shares(np.zeros(own.buckets), hashes[order], np.log([counts[w] for w in often])[order])
    expected = [(vocabulary.ids(t).tolist(), float(shares.log_counts(vocabulary.numbered(t)[1]).sum()), pl.hashes_of(vocabulary.numbered(t)[1]).tolist()) for t in given]
    if not held:
        shares.hashes = None
    asked, hash_all = [], pl.hashes_of
    monkeypatch.setattr(pl, "hashes_of", lambda words: asked.extend(words) or hash_all(words))
    parts = list(pl._looked_up([pl._tokens(given[:100]), pl._tokens([]), pl._tokens(given[100:])], vocabulary, shares))
    assert len(asked) == len(set(asked)) == len(counts) - len(vocabulary)
    got = [x for ids, logs, rare in parts for x in zip(ids, logs, rare, strict=True)]
    assert [i.tolist() for i, _, _ in got] == [e[0] for e in expected]
    if held:
        assert [x for _, x, _ in got] == pytest.approx([e[1] for e in expected])
    else:
        assert [h.tolist() for _, _, h in got] == [e[2] for e in expected]


def test_counts_given_in_pieces_are_whole(spark):
    given = texts(60)
    docs = spark.createDataFrame([(None,), *((t,) for t in given)], "text string")
    counts = Counter(w for t in given for w in pl._TOKEN.findall(t.lower()))
    rows = pl.count_words(docs).collect()
    assert len(rows) == len(counts) and {r.word: r.n for r in rows} == counts
    assert pl.count_words(docs.where("text is null")).collect() == []
