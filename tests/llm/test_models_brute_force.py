"""Toxicity scores, the lexer's pairs and the network's steps against plain versions."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gablework.llm import pseudo_likelihood, secret_scan, toxicity

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_toxicity(model, text):
    """Every word against every term, every hit's surroundings read anew."""
    s, text = model.settings, text.lower()
    tokens = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+(?:[@$*!]\w+)*", text)]
    quotes = [m.span() for m in re.finditer("\"[^\"\\n]+\"|“[^”\\n]+”|„[^“”\\n]+[“”]|«[^»\\n]+»", text)]
    worth = {}
    for i, (word, start, end) in enumerate(tokens):
        near = [(d, t) for t in model.terms if (d := distance(word, t)) <= toxicity.edits_of(t)]
        if not near or (min(near)[0] and word in model.innocent):
            continue
        edits, term = min(near)
        value = model.terms[term][1 if edits else 0] * 0.8 ** max(0, edits - 1)
        value *= s.quoted if any(a < start and end < b for a, b in quotes) else 1
        value *= s.reported if {t for t, *_ in tokens[max(0, i - s.window) : i]} & toxicity._REPORTS else 1
        value *= s.addressed if {t for t, *_ in tokens[max(0, i - s.window) : i + s.window + 1]} & toxicity._ADDRESS else 1
        worth.setdefault(term, []).append(value)
    evidence = sum(max(v) * (1 + 0.25 * min(2, len(v) - 1)) for v in worth.values())
    return 1 / (1 + math.exp(-(model.bias + model.slope * math.log1p(evidence))))


def test_toxicity_rows_equal_brute_force(spark):
    rng, texts = random.Random(2), []
    words = [f"{a}{b}{c}" for a in ("lo", "mi", "ra", "tu") for b in ("ken", "dor", "vas") for c in ("a", "el", "on", "is")]
    for i in range(400):
        t = rng.choices(words, k=rng.randint(10, 40))
        for _ in range(3 * (i % 5 == 0)):
            t[rng.randrange(len(t))] = rng.choice(["grobble", "snarvik", "grobblex", "snarwik", "flozzardly", "floozardly", '"grobble', 'snarvik"'])
        for _ in range(i % 3):
            t[rng.randrange(len(t))] = rng.choice(["said", "you", "“lo", "mi”", '"', "grabble\n"])
        texts.append(" ".join(t))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(400, None, "en", "s", None), (401, "", "en", "s", 0)], DOCS)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.terms) >= 3
    got = {r.doc_id: r for r in toxicity.scored(docs, model).collect()}
    for i, text in enumerate([*texts, "", ""]):
        assert got[i].score == pytest.approx(brute_toxicity(model, text), abs=1e-12) and got[i].predicted == int(got[i].score >= 0.7)


def brute_literals(text):
    """Lines of the form name = "literal" or name = other_name, one a line."""
    worth, known, out = dict(secret_scan.Scoring().words), {}, set()
    for m in re.finditer(r'^([A-Za-z_]\w*) = (?:"([^"]*)"|(\w+))$', text, re.MULTILINE):
        value = (m[2], m.start(2), m.end(2)) if m[2] is not None else known.get(m[3], (m[3], m.start(3), m.end(3)))
        known[m[1]] = value
        literal = value[0]
        name = min(2.5, sum(worth.get(p.lower(), 0) for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+", m[1])))
        if not name or len(literal) < 8 or re.search(r"\s|example|changeme|placeholder|your|dummy|sample|test|xxx|\*\*\*|\.\.\.|^\$|%s|localhost", literal, re.IGNORECASE):
            continue
        n, counts = len(literal), Counter(literal)
        entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
        classes = sum(bool(re.search(c, literal)) for c in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        if name + min(1, n / 24) + 0.35 * (classes - 1) + 0.25 * max(0, entropy - 2.5) >= 3:
            out.add(value[1:])
    return out


def test_lexer_equals_brute_force_on_assignments():
    rng, names = random.Random(6), ["db_pwd", "clientSecret", "colour", "api_key", "K", "A1", "authToken", "size", "bearer", "signing_key"]
    for _ in range(300):
        lines = []
        for _ in range(rng.randint(1, 12)):
            literal = "".join(rng.choices("abcXYZ019#!$_ ", k=rng.randint(3, 20)))
            lines.append(f"{rng.choice(names)} = " + (f'"{literal}"' if rng.random() < 0.6 else rng.choice([*names, "plain12", "Zk8pQ2vR7xW9"])))
        text = "\n".join(lines)
        spans = secret_scan.spans_of(text)
        base = [(s.start, s.end) for s in spans if s.kind != "literal"]
        expected = {(a, b) for a, b in brute_literals(text) if not any(x <= a and b <= y for x, y in base)}
        assert {(s.start, s.end) for s in spans if s.kind == "literal"} == expected, text


def test_a_step_follows_the_numerical_gradient():
    own = pseudo_likelihood.Settings(classes=3, buckets=2, window=1, width=4, rate=1.0)
    network = pseudo_likelihood.Network.fresh(own)
    rng = np.random.default_rng(0)
    network.values = {k: rng.normal(0, 0.5, v.shape) for k, v in network.values.items()}
    ids = rng.integers(0, 9, 30).astype(np.int32)
    contexts = network.contexts(ids)
    start = {k: v.copy() for k, v in network.values.items()}
    loss = lambda: -network.log_probabilities(contexts, ids).mean()
    numerical = {}
    for name, v in network.values.items():
        numerical[name] = np.zeros(v.shape)
        for at in np.ndindex(v.shape):
            old = v[at]
            v[at] = old + 1e-6
            up = loss()
            v[at] = old - 1e-6
            numerical[name][at] = (up - loss()) / 2e-6
            v[at] = old
    network.learn(contexts, ids, {k: np.full(v.shape, 1e12) for k, v in network.values.items()})  # so that a step is the gradient over 1e6
    for name, v in network.values.items():
        assert np.allclose((start[name] - v) * 1e6, numerical[name], atol=1e-5), name
