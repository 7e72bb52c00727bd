"""Near-duplicate documents by SimHash and pivot distance tables.

A fingerprint's bit is 1 if it is set in over half of the XXH64 hashes of a text's word shingles. Rows of equal
fingerprints fold into one node. Nodes that share the bits of some blocks meet under a key; if enough blocks are
required, no pair within the distance is missed (pigeonhole). Among nodes that meet, each has a row of a pivot
distance table: its Hamming distances to many fixed reference fingerprints. By the triangle inequality, a pair whose
coordinates differ anywhere by more than the distance cannot link; the survivors are verified by their own distance.

The near-duplicate stage meets its candidates by sketches of minima instead, and near_copies decides on the sets.

Keys that many nodes share are tiled: the rows are dealt into tiles and every pair of tiles is one small task.
Within a large group only a spanning forest of the links is kept, since components are what is asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import batches, sized, small_batches, text_batches, written
from gablework.llm.components import connected_components, forest
from gablework.llm.near_copies import node_of, shingle_set, verified


@dataclass(frozen=True)
class Scheme:
    """words: of a shingle. planes: independent 64-bit fingerprints. max_bits: over all planes. blocks, equal: keys are made of so many of the blocks of a plane. pivots: reference fingerprints. tile: nodes under a key that one task compares.

    max_bits <= blocks - equal and planes = 1 finds every pair.
    """

    words: int = 4
    planes: int = 1
    max_bits: int = 4
    blocks: int = 7
    equal: int = 3
    pivots: int = 16
    tile: int = 4096

    @property
    def masks(self) -> np.ndarray:
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        block = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(self.blocks)]
        return np.array([sum(block[i] for i in c) for c in combinations(range(self.blocks), self.equal)], dtype=np.uint64)

    def references(self) -> np.ndarray:
        return np.random.default_rng(64).integers(0, 2**64, size=(self.pivots, self.planes), dtype=np.uint64)


    def of_size(self, nodes: int) -> Scheme:
        """The scheme for so many nodes: more blocks, and with them longer keys, until a key holds few strangers. What links stays the same, as blocks - equal does."""
        out = self
        while out.blocks < 12 and nodes >> (64 * out.equal // out.blocks) > self.tile // 64:
            out = replace(out, blocks=out.blocks + 1, equal=out.equal + 1)
        return out


#: Fingerprints of 64 bits over four-word shingles, linked at four differing bits or fewer: exact.
EXACT = Scheme()
#: Sketches of five-word shingle sets: 192 one-bit minima. At a Jaccard similarity of 0.8 a bit differs with a chance of 0.1, 19 bits of 192 with a deviation of 4.2; 44 lie six deviations off.
SIMILAR = Scheme(words=5, planes=3, max_bits=44)
#: Keys of a sketch, of so many minima each: at 0.8 a pair shares none with a chance of (1 - 0.8**5)**32 = 3e-6.
BANDS, BAND = 32, 5

_MIX = np.array([1, 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=np.uint64)
#: Shingles whose bits are counted at once; bounds memory on very long texts.
_CHUNK = 1 << 16


def fingerprint(text: str | None, scheme: Scheme = EXACT) -> list[int]:
    """The unsigned fingerprints of a whole text, one for each plane; of no words (or null): zeros."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    k, count, ones = scheme.words, 0, np.zeros((scheme.planes, 64), dtype=np.int64)
    for start in range(0, max(1, len(words) - k + 1) if words else 0, _CHUNK):
        part = words[start : start + _CHUNK + k - 1]
        joined = map(b" ".join, zip(*(part[i:] for i in range(k)), strict=False)) if len(part) >= k else [b" ".join(part)]
        h = np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in joined), dtype=np.uint64)
        count += len(h)
        for plane in range(scheme.planes):
            g = h if plane == 0 else (h ^ (h >> np.uint64(29))) * _MIX[plane]
            g = g if plane == 0 else g ^ (g >> np.uint64(32))
            ones[plane] += np.unpackbits(g.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(x * 2 > count, bitorder="little").tobytes(), "little") for x in ones]


def fingerprints(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, f0, ... one long for each plane) of all documents; null texts count as empty."""
    names = [f"f{i}" for i in range(scheme.planes)]

    def hashed(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            f = np.array([fingerprint(t.as_py(), scheme) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f[:, i]) for i in range(scheme.planes))], names=["doc_id", *names])

    return small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(hashed, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def _keyed(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    masks = scheme.masks

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            node = batch.column(0).to_numpy()
            f = [batch.column(i + 1).to_numpy() for i in range(scheme.planes)]
            for plane in range(scheme.planes):
                for k, mask in enumerate(masks):
                    tag = np.uint64((plane * len(masks) + k + 1) * 0x9E3779B97F4A7C15 % 2**64)
                    key = ((f[plane].view(np.uint64) & mask) ^ tag) * np.uint64(0xFF51AFD7ED558CCD)
                    yield pa.RecordBatch.from_arrays([pa.array((key ^ (key >> np.uint64(31))).view(np.int64)), pa.array(node), *map(pa.array, f)], names=["key", "node", *(f"f{i}" for i in range(scheme.planes))])

    return run


class _Pairs:
    """Links among rows: pivot table first, own distance last."""

    def __init__(self, scheme: Scheme):
        self.most, self.references = scheme.max_bits, scheme.references()

    def table(self, f: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count(f[:, p, None] ^ self.references[None, :, p]) for p in range(f.shape[1])).astype(np.int16)

    def linked(self, f: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs i-j link."""
        ok = np.ones(len(i), dtype=bool)
        for r in range(0, table.shape[1], 4):  # a few coordinates at a time: most pairs are gone early
            at = np.flatnonzero(ok)
            ok[at] = np.abs(table[i[at], r : r + 4] - table[j[at], r : r + 4]).max(axis=1) <= self.most
        at = np.flatnonzero(ok)
        ok[at] = np.bitwise_count(f[i[at]] ^ f[j[at]]).sum(axis=1) <= self.most
        return ok

    def between(self, f: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The links among left x right (positions), in slabs of bounded memory; a position pairs with others once."""
        out = [], []
        for start in range(0, len(left), slab := max(1, 400_000 // max(1, len(right)))):
            rows = left[start : start + slab]
            near = np.ones((len(rows), len(right)), dtype=bool)
            for r in range(min(4, table.shape[1])):
                near &= np.abs(table[rows, r][:, None] - table[right, r][None, :]) <= self.most
            i, j = np.nonzero(near)
            i, j = rows[i], right[j]
            i, j = i[keep := i != j], j[keep]
            ok = self.linked(f, table, i, j)
            out[0].append(i[ok])
            out[1].append(j[ok])
        return np.concatenate(out[0] or [np.zeros(0, int)]), np.concatenate(out[1] or [np.zeros(0, int)])


#: Runs up to this length give each link, longer ones a spanning forest.
_SHORT = 8


def _met(scheme: Scheme) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key: links (kind 0) of all runs up to the tile's size; the rows of longer runs (kind 1) go on."""
    pairs, names = _Pairs(scheme), [f"f{i}" for i in range(scheme.planes)]

    def given(kind: int, key, a, b, f) -> pa.RecordBatch:
        n = len(a)
        cols = [pa.array(np.full(n, kind, dtype=np.int32)), pa.array(key) if key is not None else pa.nulls(n, pa.int64()), pa.array(a), pa.array(b) if b is not None else pa.nulls(n, pa.int64())]
        cols += [pa.array(f[:, i].view(np.int64)) if f is not None else pa.nulls(n, pa.int64()) for i in range(scheme.planes)]
        return pa.RecordBatch.from_arrays(cols, names=["kind", "key", "a", "b", *names])

    def solve(key, node, f) -> Iterator[pa.RecordBatch]:
        """Whole runs, sorted by key."""
        new = np.concatenate([[True], key[1:] != key[:-1]])
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(key)))
        many = np.repeat(length, length) > 1
        if not many.any():
            return
        key, node, f = key[many], node[many], f[many]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(start, len(key)))
        table, whole = pairs.table(f), np.repeat(length, length)
        left, right = [], []
        for lag in range(1, _SHORT):
            i = np.flatnonzero((key[:-lag] == key[lag:]) & (whole[lag:] <= _SHORT)) if len(key) > lag else np.zeros(0, int)
            if len(i):
                ok = pairs.linked(f, table, i, i + lag)
                left.append(node[i[ok]])
                right.append(node[i[ok] + lag])
        for s, n in zip(start[length > _SHORT], length[length > _SHORT], strict=True):
            at = np.arange(s, s + n)
            i, j = pairs.between(f, table, at, at)
            label = forest(n, i - s, j - s)
            moved = np.flatnonzero(label != np.arange(n))
            left.append(node[s + moved])
            right.append(node[s + label[moved]])
        if left and len(a := np.concatenate(left)):
            yield given(0, None, a, np.concatenate(right), None)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        passing = None  # the key whose run is too long for here
        for batch in batches(rows):
            key, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            f = np.stack([batch.column(2 + i).to_numpy() for i in range(scheme.planes)], axis=1).view(np.uint64)
            if passing is not None:
                n = int(np.searchsorted(key, passing, side="right"))
                if n:
                    yield given(1, key[:n], node[:n], None, f[:n])
                if n == len(key):
                    continue
                passing, key, node, f = None, key[n:], node[n:], f[n:]
            if held:
                key, node, f = (np.concatenate([h[x] for h in held] + [y]) for x, y in enumerate((key, node, f)))
                held = []
            last = int(np.searchsorted(key, key[-1], side="left"))
            if len(key) - last > scheme.tile:
                passing = key[-1]
                yield given(1, key[last:], node[last:], None, f[last:])
            else:
                held = [(key[last:], node[last:], f[last:])]
            yield from over(key[:last], node[:last], f[:last])
        for k, n, f in held:
            yield from over(k, n, f)

    def over(key, node, f) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        length = np.unique(key, return_counts=True)[1]
        long = np.repeat(length, length) > scheme.tile
        if long.any():
            yield given(1, key[long], node[long], None, f[long])
            key, node, f = key[~long], node[~long], f[~long]
        if len(key):
            yield from solve(key, node, f)

    return run


def _tiled(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) among rows (key, a, f0, ...) of keys that hold more than a tile: each pair of tiles is a group."""
    names, pairs = [f"f{i}" for i in range(scheme.planes)], _Pairs(scheme)

    def compared(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.stack([pdf[n].to_numpy() for n in names], axis=1).view(np.uint64)
        node, side = pdf["a"].to_numpy(), pdf["t"].to_numpy()
        left, right = np.flatnonzero(side == pdf["i"].iloc[0]), np.flatnonzero(side == pdf["j"].iloc[0])
        i, j = pairs.between(f, pairs.table(f), left, right)
        label = forest(len(node), i, j)
        moved = np.flatnonzero(label != np.arange(len(node)))
        return pd.DataFrame({"a": node[moved], "b": node[label[moved]]})

    tiles = rows.groupBy("key").agg(F.ceil(F.count("*") / (scheme.tile // 2)).cast("int").alias("n"))
    dealt = rows.join(tiles.hint("merge"), "key").withColumn("t", F.pmod(F.xxhash64("a"), F.col("n")).cast("int"))
    dealt = dealt.withColumn("u", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", "a", *names, "t", F.least("t", "u").alias("i"), F.greatest("t", "u").alias("j"))
    return dealt.groupBy("key", "i", "j").applyInPandas(compared, "a long, b long")


def links(nodes: DataFrame, scheme: Scheme, keyed: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join what the scheme links, among rows (node, f0, ...) of distinct fingerprints. keyed: rows (key, node, f0, ...) in place of the scheme's own keys."""
    names = [f"f{i}" for i in range(scheme.planes)]
    keyed = keyed if keyed is not None else nodes.select("node", *names).mapInArrow(_keyed(scheme), "key long, node long, " + ", ".join(f"{n} long" for n in names))
    met = written(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_met(scheme), "kind int, key long, a long, b long, " + ", ".join(f"{n} long" for n in names)), "met")
    found = met.where("kind = 0").select("a", "b")
    late = met.where("kind = 1")
    return found.unionAll(written(_tiled(late.select("key", "a", *names), scheme), "tiled")) if late.head(1) else found


def simhash_groups(docs: DataFrame, scheme: Scheme = EXACT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, f0, ..., component_id), one for each row of docs.

    component_id is the smallest id reachable by links, the row's own included. Null texts count as empty, as do texts
    of no words: their fingerprint is zero and links like any other. Rows of a null id take part; their component is
    null only if all its ids are. Repeated rows come out as often as they came in. An empty table gives no rows.
    Other columns of docs aren't read.
    """
    names = [f"f{i}" for i in range(scheme.planes)]
    prints = written(fingerprints(docs, scheme, id_col, text_col), "prints")
    node = F.col("f0") if scheme.planes == 1 else F.xxhash64(*names)
    nodes = written(prints.groupBy(*names).agg(F.min("doc_id").alias("least")).select(node.alias("node"), *names, "least"), "nodes")
    roots = connected_components(links(nodes, scheme.of_size(nodes.count())))
    rooted = nodes.select("node", "least").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    rooted = written(rooted, "rooted")
    component = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component")  # so that a join of a hot root can be split
    of = written(rooted.select("node", "root").join(component.hint("merge"), "root").select("node", "component_id"), "components")
    return prints.withColumn("node", node).join(of.hint("merge"), "node").select("doc_id", *names, "component_id")


_ODD, _FLIP = (np.random.default_rng(k).integers(0, 2**32, size=192, dtype=np.uint32) for k in (5, 6))
_ODD |= np.uint32(1)


def sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three words of one-bit minima of the set, and its keys; an empty set has those of no minimum."""
    low = np.full(len(_ODD), 2**32 - 1, dtype=np.uint32)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    for start in range(0, len(short), 4096):
        part = short[None, start : start + 4096] ^ _FLIP[:, None]
        part *= _ODD[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    mixed = (low.astype(np.uint64) + np.arange(len(low), dtype=np.uint64) * _MIX[1]) * _MIX[2]
    mixed ^= mixed >> np.uint64(29)
    mixed *= _MIX[3]
    keys = np.zeros(BANDS, dtype=np.uint64)
    for column in mixed[: BANDS * BAND].reshape(BANDS, BAND).T:
        keys = (keys ^ column) * _MIX[1]
        keys ^= keys >> np.uint64(31)
    return np.packbits((mixed >> np.uint64(63)).astype(np.uint8), bitorder="little").view("<u8").astype(np.uint64), keys


def _nodes(docs: DataFrame, scheme: Scheme) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of all documents, and (node, f0, f1, f2, keys, least) of each shingle set, with its smallest id."""
    names = [f"f{i}" for i in range(scheme.planes)]

    def named(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            sets = [shingle_set(t.as_py(), scheme.words) for t in batch.column(1)]
            f, keys = (np.stack(x).view(np.int64) for x in zip(*map(sketch, sets), strict=True))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([node_of(s) for s in sets], type=pa.int64()), *(pa.array(f[:, i]) for i in range(scheme.planes)), lists], names=["doc_id", "node", *names, "keys"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(named, "doc_id long, node long, " + ", ".join(f"{n} long" for n in names) + ", keys array<long>")
    prints = written(rows, "prints")
    return prints.select("doc_id", "node"), written(prints.groupBy("node").agg(*[F.first(n).alias(n) for n in (*names, "keys")], F.min("doc_id").alias("least")), "nodes")


def near_groups(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Rows (doc_id, component_id), one for each row of docs: components of documents whose shingle sets are near (near_copies.LEAST); what their sketches link are only the candidates."""
    of, nodes = _nodes(docs, scheme)
    keyed = nodes.select(F.explode("keys").alias("key"), "node", *[f"f{i}" for i in range(scheme.planes)])
    roots = verified(docs, nodes, connected_components(links(nodes, scheme, keyed)), scheme.words)
    rooted = written(nodes.select("node", "least").join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least"), "rooted")
    component = written(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "component")
    ids = written(rooted.select("node", "root").join(component.hint("merge"), "root").select("node", "component_id"), "components")
    return of.join(ids.hint("merge"), "node").select("doc_id", "component_id")


def kept_documents(docs: DataFrame, scheme: Scheme = SIMILAR) -> DataFrame:
    """docs without all but one document of each near-duplicate group: the one with the smallest id stays, once.

    A group is what links of a Jaccard similarity of 0.8 or more of the five-word shingle sets join.
    All columns come back as they were. Of rows that repeat an id, the first by its text stays; rows of a null id stay,
    since nothing tells them from others. Null texts and texts of no words are copies of each other. An empty table
    gives no rows.
    """
    groups = near_groups(docs.select("doc_id", "text"), scheme)
    ids = groups.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"), F.count("*").alias("n"))
    odd = written(ids.where("not stays or n > 1"), "odd")
    kept = docs.join(sized(odd.select("doc_id")), "doc_id", "left_anti").select(*docs.columns)
    repeated = odd.where("stays and n > 1").select("doc_id")
    if not repeated.head(1):
        return kept
    rows = docs.join(sized(repeated), "doc_id", "left_semi")
    tie = F.xxhash64(*[F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind])
    least = rows.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(c) for c in docs.columns]), F.struct("text", tie)).alias("row"))
    return kept.unionByName(least.select("row.*").select(*docs.columns))
