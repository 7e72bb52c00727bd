"""The vector operators and connected components against brute force, and on awkward tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gablework.llm import ann, vector_dedup
from gablework.llm.components import connected_components, forest

VECTORS = "vec_id bigint, embedding array<float>, label int"


def table(spark, x, labels):
    return spark.createDataFrame([(i, [float(v) for v in row], int(k)) for i, (row, k) in enumerate(zip(x, labels, strict=True))], VECTORS)


def clustered(n=400, width=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, width))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(scale=rng.choice([0.02, 0.12, 0.5], size=(n, 1)), size=(n, width))
    x[5], x[6], x[7] = x[4], x[4], 2 * x[4]
    return x.astype(np.float32).astype(float), rng.integers(0, 3, n)


def awkward(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, None, 1), (5, [0.0, 0.0], 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [1.0], 1), (11, [], 1), (2, [1.0, 0.0], 1)]
    return spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' as node", "1 as n", "2 as root", "3 as part", "4 as rank")


@pytest.mark.parametrize("tile", [2048, 16], ids=["one tile", "tiles"])
def test_links_equal_brute_force(spark, tile):
    x, labels = clustered()
    rows = vector_dedup.duplicate_vectors(table(spark, x, labels), vector_dedup.Settings(tile=tile, lead=4)).toPandas().sort_values("vec_id")
    size = np.linalg.norm(x, axis=1)
    near = (x @ x.T / (size[:, None] * size[None, :]) >= 0.93) & (labels[:, None] == labels[None, :]) & ~np.eye(len(x), dtype=bool)
    assert rows["n_links"].tolist() == near.sum(axis=1).tolist()
    assert rows["component_id"].tolist() == forest(len(x), *np.nonzero(near)).tolist()
    assert (rows["kept"] == (rows["vec_id"] == rows["component_id"])).all()


def test_links_awkward(spark):
    rows = vector_dedup.duplicate_vectors(awkward(spark)).collect()
    of = {r.vec_id: r for r in rows}
    assert len(rows) == 13 and of[1].n_links == of[3].n_links == 3 and of[3].component_id == 1 and not of[3].kept
    assert all(of[i].n_links == 0 and of[i].component_id == i and of[i].kept for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert of[None].n_links == 0 and of[None].component_id is None
    assert vector_dedup.duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def brute_nearest(x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    return [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k], d


def test_small_tables_are_exact(spark):
    x, labels = clustered(120)
    rows = ann.nearest_neighbours(table(spark, x, labels), F.col("vec_id") % 10 == 0).orderBy("query_id", "rank").collect()
    for q in range(0, 120, 10):
        own = [r for r in rows if r.query_id == q]
        near, d = brute_nearest(x, q, 10)
        assert [r["rank"] for r in own] == list(range(1, 11)) and [r.vec_id for r in own] == near
        assert [r.score for r in own] == pytest.approx([d[i] for i in near], abs=1e-12)


def test_recall_of_partitions(spark):
    x = np.random.default_rng(3).normal(size=(3000, 16)).astype(np.float32).astype(float)
    rows = ann.nearest_neighbours(table(spark, x, [0] * 3000), F.col("vec_id") % 50 == 0, ann.Settings(chunk=512, block=16)).collect()
    found = {}
    for r in rows:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(found[q] & set(brute_nearest(x, q, 10)[0])) for q in range(0, 3000, 50))
    assert hits / (10 * 60) >= 0.9


def test_partitions_are_balanced():
    x = np.random.default_rng(3).normal(size=(800, 8))
    graph = ann.nearest(x, x, 5, np.arange(800))
    part = ann.balanced_partition(x, graph, 8, np.random.default_rng(0))
    assert np.bincount(part, minlength=8).max() <= 105


def test_neighbours_awkward(spark):
    rows = ann.nearest_neighbours(awkward(spark), F.col("vec_id") % 1 == 0).collect()
    own = [r.vec_id for r in rows if r.query_id == 1]
    assert own == [2, 9, 3] and {r.query_id for r in rows} == {1, 2, 3, 9}
    assert ann.nearest_neighbours(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    root = forest(461, *np.array([e for e in edges if None not in e]).T)
    assert got == {i: int(root[i]) for i in {x for e in edges if None not in e and e[0] != e[1] for x in e}}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
