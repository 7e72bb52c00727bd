"""Connected components of an edge table, without gathering the edges anywhere.

Every partition first contracts its own edges to stars. If a count shows that what is left is no more than one partition
contracts at once anyway, one task ends it; else rounds alternate the large-star and small-star steps of Kiveris et al.
(2014), cut by tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import batches, written

#: Edges that a partition contracts at once; bounds its memory.
CONTRACT_ROWS = 1_000_000


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 the smallest node that each reaches over the edges left-right."""
    label = np.arange(n)
    while len(left):
        a, b = label[left], label[right]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (jumped := label[label]).tobytes() != label.tobytes():
            label = jumped
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
    return label


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = forest(len(nodes), at[: len(a)], at[len(a) :])
    moved = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[label[moved]])], names=["a", "b"])


def _contract(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    left, right, n = [], [], 0
    for batch in batches(rows):
        left.append(batch.column(0).to_numpy())
        right.append(batch.column(1).to_numpy())
        n += batch.num_rows
        if n >= CONTRACT_ROWS:
            yield _stars(np.concatenate(left), np.concatenate(right))
            left, right, n = [], [], 0
    if n:
        yield _stars(np.concatenate(left), np.concatenate(right))


def _linked_to_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    return edges.join(least.hint("merge"), "a")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, root) for each node with an edge; root is the smallest node that it reaches.

    edges: columns a and b (long), in any order and direction; nulls and loops count for nothing, repeats once.
    An empty table gives an empty result.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a != b")
    edges = written(edges.mapInArrow(_contract, "a long, b long"), "edges")
    if edges.count() <= CONTRACT_ROWS:
        return _with_roots(written(edges.coalesce(1).mapInArrow(_contract, "a long, b long"), "stars"))
    seen = None
    for _ in range(rounds):
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        # a node whose least neighbour is itself hands on nothing new: its edges stay as they are
        large = _linked_to_least(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = _linked_to_least(large, least).where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now["n"] == 0 or (seen is not None and (now["n"], now["h"]) == seen):
            break
        seen = (now["n"], now["h"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return _with_roots(edges)


def _with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
