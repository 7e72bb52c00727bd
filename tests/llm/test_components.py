"""Components by one last contraction and by star rounds; the sides of joins that are broadcast."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pytest

from gablework.llm import common, components, simhash

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.mark.parametrize("most", [1_000_000, 10], ids=["one task", "rounds"])
def test_components_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(components, "CONTRACT_ROWS", most)
    rng = random.Random(5)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(i + 1, i) for i in range(500, 540)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    root = components.forest(541, *np.array(edges).T)
    assert got == {i: int(root[i]) for i in {x for e in edges if e[0] != e[1] for x in e}}


@pytest.mark.parametrize("most", [1_000_000, 0], ids=["broadcast", "shuffled"])
def test_kept_rows_do_not_depend_on_the_join(spark, most, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", most)
    words = random.Random(1).choices([f"w{i}" for i in range(900)], k=900)
    texts = [" ".join(words[i * 30 : i * 30 + 60]) for i in range(0, 28, 2)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate([*texts, *texts[:5]])]
    rows += [(3, "b " + texts[3], "en", "s", 1), (3, "a " + texts[3], "en", "s", 2), (None, texts[0], "en", "s", 3)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "map('k', doc_id) as extra")
    kept = simhash.kept_documents(docs).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == list(range(14)) and sum(r.doc_id is None for r in kept) == 1
    assert next(r for r in kept if r.doc_id == 3).text == min(texts[3], "a " + texts[3]) and kept[0].extra is not None
