"""Long words, long quotations and many candidate words of the toxicity operator."""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from gablework.llm import toxicity

BRUTE = re.compile("\"[^\"\\n]+\"|“[^”\\n]+”|„[^“”\\n]+[“”]|«[^»\\n]+»")


@settings(max_examples=300, deadline=None)
@given(st.text('ab "“”„«»\n', max_size=40))
def test_quotations_equal_the_pattern(text):
    assert toxicity.quotations(text) == [m.span() for m in BRUTE.finditer(text)]


def test_quotations_are_linear():
    began = time.time()
    toxicity.quotations("“" * 200_000 + "\n" + "\"“„«" * 50_000)
    assert time.time() - began < 5


def model(*terms):
    return toxicity.Model({t: (4.0, 1.0) for t in terms}, -3.0, 2.0, toxicity.Settings())


def test_words_of_any_length():
    term = "snarvik" * 10
    found = model(term).hits(f"a {term} and a {term[:-1]}")
    assert [(t, e) for t, e, *_ in found] == [(term, 0), (term, 1)]
    assert model("grobble").hits("x" * 200_000) == []


def test_quotations_of_any_length():
    own = model("grobble")
    for n in (10, 100, 5_000):
        (hit,) = own.hits('"' + "lo " * n + "grobble " + "mi " * n + '"')
        assert hit[2] == toxicity.Settings().quoted
    (hit,) = own.hits('"lo" grobble "mi"')
    assert hit[2] == 1.0
