"""Vectors far from the origin, very large and very small ones, and labels that are no ints."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gablework.llm import ann, vector_dedup
from gablework.llm.vectors import distances


def searched(x, queries, k=10):
    left = pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": list(x)})
    right = pd.DataFrame({"query_id": queries, "query": list(x[queries])})
    got = ann._search(k)(None, left, right)
    return {q: got[got["query_id"] == q] for q in queries}


@pytest.mark.parametrize("size", [0.0, 1.0, 1e3, 1e4, 1e5, 1e6, 1e8])
def test_neighbours_far_from_the_origin(size):
    rng = np.random.default_rng(1)
    x = size + rng.normal(scale=1e-3, size=(300, 16))
    x[150:] += size  # two centres
    for q, own in searched(x, np.array([0, 7, 280])).items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = [i for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert own["vec_id"].tolist() == near and own["score"].tolist() == d[near].tolist()


@pytest.mark.parametrize("scale", [1e-200, 1e-160, 1e155, 1e300])
def test_neighbours_of_any_scale(scale):
    x = np.random.default_rng(2).normal(size=(100, 8))
    for q, own in searched(x * scale, np.array([3, 50])).items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = [i for i in np.argsort(d) if i != q][:10]
        assert own["vec_id"].tolist() == near and np.allclose(own["score"] / scale, d[near], rtol=1e-12)


def test_distances_at_the_edge():
    x, y = np.array([[1.7e308, 0.0], [3e-300, 4e-300], [1.0, 1.0]]), np.array([[-1.7e308, 0.0], [0.0, 0.0], [1.0, 1.0]])
    assert distances(x, y).tolist()[::2] == [np.inf, 0.0] and distances(x, y)[1] == pytest.approx(5e-300, rel=1e-12)


@pytest.mark.parametrize("scale", [1e-170, 1.0, 1e170])
def test_links_of_any_scale(spark, scale):
    x = np.array([[1.0, 2.0, 3.0], [1.01, 2.0, 3.0], [-1.0, 5.0, 0.0]]) * scale
    rows = [(i, v.tolist(), k) for k in ("a", "b") for i, v in enumerate(x, start=10 * (k == "b"))]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.duplicate_vectors(docs).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_labels_beyond_int(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0], 2**40), (2, [1.0, 0.0], 2**40), (3, [1.0, 0.0], 0)], "vec_id bigint, embedding array<float>, label bigint")
    assert {r.vec_id: r.component_id for r in vector_dedup.duplicate_vectors(docs).collect()} == {1: 1, 2: 1, 3: 3}


def test_partitions_grow_with_the_table(spark):
    x = np.random.default_rng(3).normal(size=(3000, 8)) + 1e4
    index = ann.fit_index(x, ann.Settings(), rows=2_000_000)
    assert index.parts == 40 and index.route(x[:5], 40).shape == (5, 40)
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>, label int")
    found = ann.nearest_neighbours(rows, F.col("vec_id") % 50 == 0, ann.Settings(partition_rows=100)).groupBy("query_id").agg(F.collect_set("vec_id").alias("ids")).collect()
    hits = 0
    for r in found:
        d = ((x - x[r.query_id]) ** 2).sum(axis=1)
        hits += len(set(np.argsort(d)[1:11]) & set(r.ids))
    assert len(found) == 60 and hits / 600 >= 0.9
