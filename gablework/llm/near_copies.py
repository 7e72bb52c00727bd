"""Near copies by the Jaccard similarity of their shingle sets, decided on the sets themselves.

Candidates come from sketches and only say which documents may be near; each document is then held against the others of
its candidate component by the sets, in whole numbers. Components are formed of what holds. Large candidate components
are dealt into tiles, and every pair of tiles is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import batches, sized, small_batches, text_batches, texts_of, written
from gablework.llm.components import connected_components

#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
#: Documents and shingles of a tile, about, at most.
TILE_ROWS, TILE_SHINGLES = 512, 1_000_000


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """The XXH64 hashes of a whole text's word shingles, sorted, each once; of fewer words than a shingle, of them all; of none, empty."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = map(b" ".join, zip(*(parts[i:] for i in range(words)), strict=False)) if len(parts) >= words else [b" ".join(parts)]
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in joined), dtype=np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    return int(np.array([xxhash.xxh64_intdigest(shingles.astype("<u8").tobytes(), 7)], dtype=np.uint64).view(np.int64)[0])


def near_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join what a similarity of LEAST or more joins, directly or by way of others: a walk from each document to all not yet reached."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    mark, out = np.zeros(len(values) + 1, dtype=bool), []
    rest = np.flatnonzero(sizes)  # an empty set is near none but its equal, which is the same node
    p, q = LEAST
    while len(rest) > 1:
        todo, rest = [int(rest[0])], rest[1:]
        at = np.concatenate([own[i] for i in rest])
        while todo and len(rest):
            i = todo.pop()
            mark[own[i]] = True
            shared = np.add.reduceat(mark[at], np.append(0, np.cumsum(sizes[rest])[:-1]), dtype=np.int64)
            mark[own[i]] = False
            near = (p + q) * shared >= p * (sizes[i] + sizes[rest])
            if near.any():
                out += [(i, int(j)) for j in rest[near]]
                todo += rest[near].tolist()
                at, rest = at[np.repeat(~near, sizes[rest])], rest[~near]
    return out


def _sets(words: int):
    """Rows (node, shingles) of texts."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            made = [shingle_set(t, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in made], type=pa.int64()), pa.array([s.view(np.int64) for s in made], type=pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _decided(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (root, i, j, node, shingles) sorted by the first three: the links (a, b) of each run."""
    key, nodes, sets, links = None, [], [], []

    def settle() -> None:
        links.extend((nodes[i], nodes[j]) for i, j in (near_pairs(sets) if len(sets) > 1 else ()))

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], type=pa.int64()) for k in (0, 1)], names=["a", "b"])
        links.clear()
        return out

    for batch in batches(rows):
        at = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
        own, lists = batch.column(3).to_pylist(), batch.column(4)
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        for r in range(len(at)):
            if (now := tuple(at[r])) != key:
                settle()
                key, nodes, sets = now, [], []
            nodes.append(own[r])
            sets.append(flat[offsets[r] : offsets[r + 1]].copy())
        yield given()
    settle()
    yield given()


def verified(docs: DataFrame, nodes: DataFrame, roots: DataFrame, words: int) -> DataFrame:
    """Rows (node, root) of the components that near copies form, among nodes of the same candidate component.

    docs: (doc_id, text). nodes: (node, least) with the id of one of its documents, null if none has one. roots: (node, root) of the candidates.
    """
    roots = written(roots, "candidates")
    ids = written(nodes.select("node", "least").join(roots.hint("merge"), "node").where("least is not null").select(F.col("least").alias("doc_id")).distinct(), "ids")
    texts = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = texts.join(sized(ids), "doc_id", "left_semi").unionAll(texts.where("doc_id is null"))
    read = texts.select("text").mapInArrow(_sets(words), "node long, shingles array<long>")
    sets = written(read.join(roots.hint("merge"), "node", "left_semi"), "read").groupBy("node").agg(F.first("shingles").alias("shingles"))
    rows = written(sets.join(roots.hint("merge"), "node").select("root", "node", "shingles"), "sets")
    tiles = rows.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum(F.size("shingles")) / TILE_SHINGLES, F.lit(1))).cast("int").alias("n"))
    dealt = rows.join(written(tiles, "tiles").hint("merge"), "root").withColumn("t", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where("u != t or n = 1")
    dealt = dealt.select("root", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"), "node", "shingles")
    # written, so that no task holds a Python worker for these and one more for what components do with them
    return connected_components(written(dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_decided, "a long, b long"), "links"))
