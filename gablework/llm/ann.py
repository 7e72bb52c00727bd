"""Approximate nearest neighbours over learned partitions.

On a bounded sample, the neighbour graph is cut into balanced partitions; a small network then learns, from a vector,
how its neighbours spread over them. It puts every row of the table into its most probable partition and sends a query
to its most probable ones, as many as held-out sample queries needed for the recall aimed at. Candidates there are
reranked by their exact distance.

Partitions are read in chunks of bounded size against blocks of queries, each pair a task of its own, so neither a
large partition nor many queries meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gablework.llm.common import batches, column_of, written
from gablework.llm.vectors import distances, is_usable, matrix, rows_of


@dataclass(frozen=True)
class Settings:
    """neighbours: returned for each query. partitions: of the index, at least; partition_rows: rows for which it gets another one, up to most_partitions. sample_values: numbers in the sample that the index is fitted on, at most; sample_rows: its vectors, at most. graph: neighbours in the graph. hidden: units of the network. recall: aimed at on held-out sample queries. chunk: candidates of a task, about; block: its queries, about; they grow to large_chunk and large_block where a candidate would go to over copies tasks."""

    neighbours: int = 10
    partitions: int = 16
    partition_rows: int = 50_000
    most_partitions: int = 256
    sample_values: int = 1_000_000
    sample_rows: int = 8_192
    graph: int = 10
    hidden: int = 128
    epochs: int = 25
    recall: float = 0.94
    chunk: int = 4_096
    block: int = 1_024
    large_chunk: int = 16_384
    large_block: int = 8_192
    copies: int = 16
    seed: int = 7


def nearest(x: np.ndarray, queries: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Positions of the k rows of x nearest to each query; skip: a position to leave out for each."""
    half, out = (x * x).sum(axis=1) / 2, []
    for start in range(0, len(queries), 512):
        d = half[None, :] - queries[start : start + 512] @ x.T
        if skip is not None:
            d[np.arange(len(d)), skip[start : start + 512]] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_partition(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A partition for each row, none above 1.05 times its share: balanced means to begin with, then rows move to where most of their graph neighbours are."""
    n, most = len(x), int(np.ceil(1.05 * len(x) / parts))
    centres = x[rng.choice(n, parts, replace=False)]
    part = np.zeros(n, dtype=int)
    for _ in range(8):
        gap = (centres * centres).sum(axis=1)[None, :] / 2 - x @ centres.T
        order = np.argsort(np.partition(gap, 1, axis=1)[:, 0] - np.partition(gap, 1, axis=1)[:, 1], kind="stable")
        room, wish = np.full(parts, most), np.argsort(gap, axis=1)
        for i in order:
            part[i] = next(p for p in wish[i] if room[p] > 0)
            room[part[i]] -= 1
        centres = np.stack([x[part == p].mean(axis=0) if (part == p).any() else x[rng.integers(n)] for p in range(parts)])
    for _ in range(6):
        votes = np.zeros((n, parts), dtype=np.int32)
        for k in range(graph.shape[1]):
            np.add.at(votes, (np.arange(n), part[graph[:, k]]), 1)
            np.add.at(votes, (graph[:, k], part), 1)
        to, size = votes.argmax(axis=1), np.bincount(part, minlength=parts)
        gain = votes[np.arange(n), to] - votes[np.arange(n), part]
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if size[to[i]] < most:
                size[part[i]] -= 1
                part[i] = to[i]
                size[part[i]] += 1
    return part


class Router:
    """A network of one hidden layer: the probability of each partition for a vector."""

    def __init__(self, width: int, hidden: int, parts: int, rng: np.random.Generator):
        self.w = [rng.normal(0, 1 / np.sqrt(width), (width, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), (hidden, parts)), np.zeros(parts)]
        self.scale = 1.0

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(0, x @ self.w[0] + self.w[1])
        z = h @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return h, p / p.sum(axis=1, keepdims=True)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x / self.scale)[1]

    def fit(self, x: np.ndarray, target: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
        self.scale = float(np.sqrt((x * x).mean())) or 1.0
        x = x / self.scale
        first, second, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h, p = self._forward(x[at])
                dz = (p - target[at]) / len(at)
                dh = (dz @ self.w[2].T) * (h > 0)
                t += 1
                for w, m, v, g in zip(self.w, first, second, (x[at].T @ dh, dh.sum(axis=0), h.T @ dz, dz.sum(axis=0)), strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= 0.003 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


@dataclass
class Index:
    """router: None if there are too few vectors for partitions. probes: partitions that a query is sent to. centre, size: vectors are routed by their difference from the sample's mean, over its largest."""

    router: Router | None
    parts: int
    probes: int
    centre: np.ndarray | float = 0.0
    size: float = 1.0

    def route(self, x: np.ndarray, probes: int) -> np.ndarray:
        if self.router is None:
            return np.zeros((len(x), 1), dtype=np.int32)
        x = np.clip((x - self.centre) / self.size, -1e6, 1e6)
        return np.argsort(-self.router.probabilities(x), axis=1, kind="stable")[:, :probes].astype(np.int32)


def fit_index(sample: np.ndarray, settings: Settings = Settings(), rows: int = 0) -> Index:
    """The index of a sample of a table of so many rows: an eighth of the sample are the queries that decide on the number of probes."""
    rng, k = np.random.default_rng(settings.seed), settings.neighbours
    parts = max(settings.partitions, min(settings.most_partitions, rows // settings.partition_rows, len(sample) // 16))
    if len(sample) < max(16 * parts, 8 * k):
        return Index(None, 1, 1)
    settings = replace(settings, partitions=parts)
    centre = sample.mean(axis=0)
    scale = float(np.abs(sample - centre).max()) or 1.0
    sample = (sample - centre) / scale
    held = np.arange(len(sample)) % 8 == 7
    x, queries = sample[~held], sample[held]
    graph = nearest(x, x, settings.graph, np.arange(len(x)))
    part = balanced_partition(x, graph, settings.partitions, rng)
    target = np.zeros((len(x), settings.partitions))
    np.add.at(target, (np.arange(len(x)), part), 2.0)
    for c in range(graph.shape[1]):
        np.add.at(target, (np.arange(len(x)), part[graph[:, c]]), 1.0)
    router = Router(x.shape[1], settings.hidden, settings.partitions, rng)
    router.fit(x, target / target.sum(axis=1, keepdims=True), settings.epochs, rng)
    index = Index(router, settings.partitions, settings.partitions)  # of the sample as it is now; centre and scale follow
    home, truth, routed = index.route(x, 1)[:, 0], nearest(x, queries, k), index.route(queries, settings.partitions)
    rank = np.argsort(routed, axis=1)[np.arange(len(queries))[:, None], home[truth]]
    for index.probes in range(1, settings.partitions + 1):
        if (rank < index.probes).mean() >= settings.recall:
            break
    index.centre, index.size = centre, scale
    return index


def _spread(rows: DataFrame, index: Index, probes: int, names: tuple[str, str], kind: str) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(parts):
            routed = index.route(rows_of(batch.column(1)), probes)
            at = pa.array(np.repeat(np.arange(batch.num_rows), routed.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(routed.ravel()), batch.column(0).take(at), batch.column(1).take(at)], names=["part", *names])

    return rows.mapInArrow(run, f"part int, {names[0]} long, {names[1]} {kind}")


#: Pairs whose exact distance is taken at once; bounds memory.
_EXACT = 16_384


def _near_origin(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Candidates and queries by their difference from the candidates' middle, by a power of two so that no square overflows; and the share of their squares that rounding can move a squared distance by."""
    width = x.shape[1]
    power = int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)))[1])
    x, q = np.ldexp(x, -power), np.ldexp(q, -power)
    centre = np.median(x[:: max(1, len(x) // 512)], axis=0)
    x, q = x - centre, q - centre
    power = int(np.frexp(max(np.abs(x).max(initial=0.0), np.abs(q).max(initial=0.0)))[1])
    return np.ldexp(x, -power), np.ldexp(q, -power), (2 * width + 16) * 2.0**-52


def _search(k: int):
    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        x, q = matrix(left["embedding"]), matrix(right["query"])
        ids, query_ids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        heads = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # rows that repeat an id count as one
        near_x, near_q, allowed = _near_origin(x, q)
        half, out = (near_x * near_x).sum(axis=1), []
        step = max(16, 524_288 // len(x))
        for start in range(0, len(q), step):
            part = near_q[start : start + step]
            own = (part * part).sum(axis=1)
            rough = half[None, :] - 2 * (part @ near_x.T) + own[:, None]
            slack = allowed * (half[None, :] + own[:, None])  # what rounding can have moved it by
            other = query_ids[start : start + step, None] != ids[None, :]
            most_far = np.where(other, rough + slack, np.inf)
            most = min(k, len(heads)) - 1
            least = most_far if len(heads) == len(x) else np.minimum.reduceat(most_far, heads, axis=1)
            # all that rounding could bring among the nearest; equal distances stay in, for the smaller id
            edge = np.partition(least, most, axis=1)[:, most]
            i, j = np.nonzero((rough - slack <= edge[:, None]) & other)
            exact = np.concatenate([distances(x[j[at : at + _EXACT]], q[start + i[at : at + _EXACT]]) for at in range(0, max(1, len(i)), _EXACT)])
            order = np.lexsort((exact, ids[j], i))
            i, j, exact = i[order], j[order], exact[order]
            once = np.append(True, (i[1:] != i[:-1]) | (ids[j[1:]] != ids[j[:-1]]))[: len(i)]
            i, j, exact = i[once], j[once], exact[once]
            order = np.lexsort((ids[j], exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i, side="left")
            near = np.arange(len(i)) - first < k
            out.append((query_ids[start + i[near]], ids[j[near]], exact[near]))
        a, b, c = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    return run


def nearest_neighbours(vectors: DataFrame, is_query: Column, settings: Settings = Settings()) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each query its nearest candidates found, nearest first, ties to the smaller id.

    vectors: (vec_id, embedding). Queries: the rows that is_query picks; candidates: all rows of another id. score: the
    Euclidean distance in double precision. Null vectors, zero vectors, those with null or non-finite components or of
    another length than most, and rows of a null id take no part. Rows that repeat an id count as one whose distance is
    the smallest. Fewer candidates than asked for are all returned; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(is_usable("embedding") & F.col("vec_id").isNotNull())
    widths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if widths is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    width, n = widths["width"], widths["n"]
    rows = rows.where(F.size("embedding") == width)
    most = max(1, min(settings.sample_rows, settings.sample_values // width))
    mark = F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000))
    picked = rows.withColumn("mark", mark).where(F.col("mark") < int(1_000_000 * min(1.0, 1.2 * most / n)))
    sample = sorted((r["vec_id"], tuple(r["embedding"])) for r in picked.orderBy("mark", "vec_id").limit(most).collect())
    index = fit_index(matrix([v for _, v in sample]), settings, n)
    kind = dict(rows.dtypes)["embedding"]
    indexed = written(_spread(rows, index, 1, ("vec_id", "embedding"), kind), "index")
    queries = _spread(rows.where(is_query), index, index.probes, ("query_id", "query"), kind)
    queries = written(queries, "queries")
    grown = lambda least, most: F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(F.count("*") / settings.copies)))
    chunks = indexed.groupBy("part").agg(F.ceil(F.count("*") / grown(settings.chunk, settings.large_chunk)).cast("int").alias("chunks"))
    blocks = queries.groupBy("part").agg(F.ceil(F.count("*") / grown(settings.block, settings.large_block)).cast("int").alias("blocks"))
    grid = F.broadcast(written(chunks.join(blocks, "part"), "grid"))  # a row for each partition
    left = indexed.join(grid, "part").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int"))
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("part", "chunk", "block", "vec_id", "embedding")
    right = queries.join(grid, "part").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int"))
    right = right.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("part", "chunk", "block", "query_id", "query")
    by = ("part", "chunk", "block")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(_search(settings.neighbours), "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= settings.neighbours).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
