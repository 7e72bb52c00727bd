"""Near-duplicate embeddings within a label by cosine, compared in PCA-ordered tiles.

Equal vectors of a label fold into one node with a count. Nodes of a label are dealt into bins along the first
principal component, and bins into tiles of bounded size; two bins are compared only if their intervals are near
enough for any pair to reach the threshold. A pair of tiles is one task: it turns both into the PCA basis, adds up the
products of the leading dimensions first, and bounds what the other dimensions can still add by the product of the
vectors' suffix norms (Cauchy-Schwarz). Pairs whose bound falls below the threshold are dropped; the last are
verified by the cosine of the vectors as they came. Links are counted, not listed: a task gives the number of links of
each node and a spanning forest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import batches, column_of, written
from gablework.llm.components import connected_components, forest
from gablework.llm.vectors import at_one, is_usable, matrix, rows_of


@dataclass(frozen=True)
class Settings:
    """threshold: least cosine of a link. tile: nodes of a tile, about, at most; it grows to large_tile for a label that would take over copies tiles, since each row goes to every tile that it meets. lead: dimensions of the first sum; each later sum takes twice as many. slab: rows of a tile that are compared at once."""

    threshold: float = 0.93
    tile: int = 2048
    large_tile: int = 16_384
    copies: int = 32
    lead: int = 8
    slab: int = 256


def principal_axes(rows: DataFrame, width: int) -> np.ndarray:
    """The orthonormal axes (columns) of the unit vectors' second moments, largest first. The moments are summed on the executors; width * width numbers come back."""

    def moments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches(parts):
            x = at_one(rows_of(column_of(batch, "embedding")))
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "value"])

    sums = rows.select("embedding").mapInArrow(moments, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(width * width)
    for r in sums:
        total[r["at"]] = r["value"]
    values, axes = np.linalg.eigh(total.reshape(width, width))
    return axes[:, np.argsort(-values, kind="stable")]


def near_pairs(x: np.ndarray, y: np.ndarray, axes: np.ndarray, settings: Settings = Settings()) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of the rows of x and of y whose cosine reaches the threshold."""
    width, least = x.shape[1], settings.threshold
    x, y = at_one(x), at_one(y)
    size_x, size_y = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
    a, b = (x / size_x[:, None]) @ axes, (y / size_y[:, None]) @ axes
    cuts, step = [0], settings.lead
    while cuts[-1] < width:
        cuts.append(min(width, cuts[-1] + step))
        step *= 2
    rest = lambda m: [np.sqrt(np.maximum(0.0, (m[:, c:] ** 2).sum(axis=1))) for c in cuts[1:]]
    rest_a, rest_b = rest(a), rest(b)
    found = [], []
    for start in range(0, len(a), settings.slab):
        rows = np.arange(start, min(len(a), start + settings.slab))
        i = j = None
        dense = np.zeros((len(rows), len(b)))
        for k in range(len(cuts) - 1):
            lo, hi = cuts[k], cuts[k + 1]
            if i is None:
                dense += a[rows, lo:hi] @ b[:, lo:hi].T
                alive = dense + rest_a[k][rows][:, None] * rest_b[k][None, :] >= least - 1e-9
                if alive.mean() < 0.1 or k == len(cuts) - 2:
                    i, j = np.nonzero(alive)
                    sums = dense[i, j]
            else:
                sums = sums + np.einsum("nd,nd->n", a[rows[i], lo:hi], b[j, lo:hi])
                keep = sums + rest_a[k][rows[i]] * rest_b[k][j] >= least - 1e-9
                i, j, sums = i[keep], j[keep], sums[keep]
        exact = np.einsum("nd,nd->n", x[rows[i]], y[j]) / (size_x[rows[i]] * size_y[j]) >= least
        found[0].append(rows[i[exact]])
        found[1].append(j[exact])
    return np.concatenate(found[0] or [np.zeros(0, int)]), np.concatenate(found[1] or [np.zeros(0, int)])


def _tiles(nodes: DataFrame, axes: np.ndarray, settings: Settings) -> DataFrame:
    """The nodes with their tile and every tile that it meets: rows (label, i, j, side, node, n, embedding)."""
    first = axes[:, 0].copy()

    def placed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            x = at_one(rows_of(column_of(batch, "embedding")))
            yield batch.append_column("along", pa.array((x / np.linalg.norm(x, axis=1, keepdims=True)) @ first))

    kind = dict(nodes.dtypes)
    nodes = written(nodes.mapInArrow(placed, f"label {kind['label']}, node long, n long, embedding {kind['embedding']}, along double"), "placed")
    largest = nodes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    tile = max(settings.tile, min(settings.large_tile, largest // settings.copies))
    bins = min(512, max(1, math.ceil(largest / tile)))
    cuts = nodes.groupBy("label").agg(F.percentile_approx("along", [i / bins for i in range(1, bins)] or [0.5], 10_000).alias("cuts"))
    cuts = written(cuts if bins > 1 else cuts.withColumn("cuts", F.slice("cuts", 1, 0)), "cuts")
    bin_of = F.size(F.filter("cuts", lambda c: c < F.col("along")))
    binned = written(nodes.join(cuts, "label").withColumn("bin", bin_of).drop("cuts"), "binned")
    spans = binned.groupBy("label", "bin").agg(F.min("along").alias("lo"), F.max("along").alias("hi"), F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    spans = written(spans, "spans")
    reach = math.sqrt(max(0.0, 2 - 2 * settings.threshold)) + 1e-9  # of unit vectors that link, no coordinate differs by more
    other = spans.select("label", F.col("bin").alias("bin2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("tiles").alias("tiles2"))
    met = spans.join(other, "label").where((F.col("lo2") <= F.col("hi") + reach) & (F.col("lo") <= F.col("hi2") + reach))
    met = met.groupBy("label", "bin").agg(F.first("tiles").alias("tiles"), F.collect_list(F.struct("bin2", "tiles2")).alias("others"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = binned.join(met, ["label", "bin"]).withColumn("mine", F.col("bin") * 1_000_000 + own)
    theirs = F.flatten(F.transform("others", lambda o: F.transform(F.sequence(F.lit(0), o["tiles2"] - 1), lambda t: o["bin2"] * 1_000_000 + t)))
    dealt = dealt.withColumn("theirs", F.explode(theirs))
    return dealt.select("label", F.least("mine", "theirs").alias("i"), F.greatest("mine", "theirs").alias("j"), (F.col("mine") > F.col("theirs")).alias("second"), "node", "n", "embedding")


def duplicate_vectors(vectors: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of vectors (vec_id, embedding, label).

    n_links: other rows of the label that link directly. component_id: the smallest vec_id reachable, the own
    included. kept: whether that is the own. Labels of any type that can be compared. Null vectors, zero vectors, those with null or non-finite components, rows
    of a null label or id, and vectors of another length than most have no links; their component is their own id (null
    if that is), and they are kept. Rows that repeat an id are vectors of their own. An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    usable = is_usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    common = rows.where(usable).groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if common is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = common["width"]
    takes_part = usable & (F.size("embedding") == width)
    # two hashes of 64 bits name a vector of a label; a number that is written once stands for them from then on
    keyed = rows.select("vec_id", "label", "embedding", *[F.when(takes_part, F.xxhash64(F.lit(k), "label", "embedding")).alias(f"h{k}") for k in (1, 2)])
    nodes = keyed.where("h1 is not null").groupBy("h1", "h2").agg(F.first("label").alias("label"), F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding"))
    named = written(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    nodes = named.select("label", "node", "n", "embedding")
    axes = principal_axes(nodes, width)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        x, node, n, second = matrix(pdf["embedding"]), pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["second"].to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            left = right = np.arange(len(x))
        else:
            left, right = np.flatnonzero(~second), np.flatnonzero(second)
        i, j = near_pairs(x[left], x[right], axes, settings) if len(left) and len(right) else (np.zeros(0, int), np.zeros(0, int))
        i, j = left[i], right[j]
        i, j = i[keep := i != j], j[keep]
        links = np.bincount(i, weights=n[j], minlength=len(x))
        if left is not right:
            links += np.bincount(j, weights=n[i], minlength=len(x))
        label = forest(len(x), i, j)
        some = np.flatnonzero(links)
        return pd.DataFrame({"node": node[some], "links": links[some].astype(np.int64), "to": node[label[some]]})

    # two tiles of a pair stand on both sides of it, a tile with itself only once: each row goes there once
    found = written(_tiles(nodes, axes, settings).groupBy("label", "i", "j").applyInPandas(compared, "node long, links long, to long"), "links")
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counted = written(found.groupBy("node").agg(F.sum("links").alias("links")), "counted")
    joined = named.select("node", "h1", "h2", "least", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counted, "node", "left")
    joined = written(joined.select("h1", "h2", "root", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "rooted")
    component = written(joined.groupBy("root").agg(F.min("least").alias("component_id")), "component")
    of = written(joined.join(component.hint("merge"), "root").select("h1", "h2", "n_links", "component_id"), "of")
    linked = keyed.where("h1 is not null").select("vec_id", "h1", "h2").join(of.hint("merge"), ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
