"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

A text is compressed with either dictionary, block by block so that the dictionary matters to its end. The difference
of the compressed sizes over their sum says which kind of text it resembles; with the text's own compressibility, which
says how much any dictionary can save on it, it becomes a score by a logistic curve that is fitted on labelled
documents the dictionaries haven't seen. Nothing but compressed sizes goes into a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gablework.llm.common import column_of, small_batches, text_batches, texts_of
from gablework.llm.labelled import fold, labelled_sample


@dataclass(frozen=True)
class Settings:
    """sample: labelled documents that are learned from, at most: half for the dictionaries, half for the curve. dictionary_blocks: blocks that a dictionary is built from, about, at most. block, large_block: bytes. threshold: score of predicted 1. held_out: the fold (modulus, remainder) never learned from."""

    sample: int = 12_000
    dictionary_blocks: int = 6_000
    dictionary_bytes: int = 65_536
    block: int = 1_024
    large_block: int = 8_192
    level: int = 3
    threshold: float = 0.3
    held_out: tuple[int, int] = (5, 0)


def _blocks(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their own end."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


@dataclass
class Model:
    """good, bad: dictionaries. weights: of the features, the constant first. None: no label of one kind, score is the prior."""

    good: bytes | None
    bad: bytes | None
    weights: np.ndarray | None
    prior: float
    settings: Settings
    _made: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_made": {}}

    def _compressors(self):
        if not self._made:
            options = {"level": self.settings.level, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
            for name, data in (("good", self.good), ("bad", self.bad)):
                self._made[name] = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(data), **options)
            self._made["plain"] = zstandard.ZstdCompressor(**options)
        return self._made["good"], self._made["bad"], self._made["plain"]

    def features(self, text: str) -> list[float]:
        """Of blocks of either size the difference of the compressed sizes, over their sum and over the text's; and the share that the text compresses to without a dictionary. All are of the whole text."""
        good, bad, plain = self._compressors()
        data = text.encode("utf-8", "surrogatepass")
        out = []
        for size in (self.settings.block, self.settings.large_block):
            parts = _blocks(data, size)
            g, b = (sum(len(c.compress(p)) for p in parts) for c in (good, bad))
            out += [(b - g) / max(1, b + g), (b - g) / (len(data) + 16)]
        return [*out, len(plain.compress(data)) / (len(data) + 16)]

    def score(self, text: str) -> float:
        return self.prior if self.weights is None else float(scores(np.array([self.features(text)]), self.weights)[0])


def _design(x: np.ndarray) -> np.ndarray:
    squares = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i, x.shape[1])]
    return np.stack([np.ones(len(x)), *x.T, *squares], axis=1)


def scores(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_design(x) @ weights, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, importance: np.ndarray) -> np.ndarray:
    """Logistic weights under a light ridge; importance undoes the sample's balance of labels."""
    design = _design(x)
    w, ridge = np.zeros(design.shape[1]), 0.05 * np.eye(design.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve((design * (importance * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (importance * (y - p)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Learns from the labelled documents outside the held-out fold, by no other input than their texts. Without labels of both kinds every score is the share of label 1 (0.5 if there are none). Of rows that repeat an id the first text by order is learned from; null texts count as empty; an empty table gives the score of no labels."""
    modulus, out = settings.held_out
    usable = fold(modulus) != out
    counts = {r["y"]: r["n"] for r in labels.where(F.col("quality").isin(0, 1) & usable).groupBy(F.col("quality").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    prior = counts.get(1, 0) / total if total else 0.5
    sample = labelled_sample(docs, labels, "quality", usable, settings.sample)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    first, second = sample.where(half == 0), sample.where(half == 1)
    blocks = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.sum(F.ceil(F.octet_length("text") / settings.block)).alias("n")).collect()}
    if not all(blocks.get(y) for y in (0, 1)):
        return Model(None, None, None, prior, settings)
    share = {y: min(1.0, settings.dictionary_blocks / blocks[y]) for y in (0, 1)}

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            kept = []
            for y, doc_id, text in zip(column_of(batch, "y").to_pylist(), column_of(batch, "doc_id").to_pylist(), texts_of(batch), strict=True):
                rng = np.random.default_rng([doc_id & 0xFFFFFFFF, y])
                kept += [(y, b) for b in _blocks(text.encode(), settings.block) if rng.random() < share[y]]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in kept], type=pa.int32()), pa.array([b for _, b in kept], type=pa.binary())], names=["y", "block"])

    taken = sorted((r["y"], bytes(r["block"])) for r in first.mapInArrow(cut, "y int, block binary").collect())
    good, bad = (dictionary([b for y, b in taken if y == kind], settings.dictionary_bytes) for kind in (1, 0))
    if not good or not bad:
        return Model(None, None, None, prior, settings)
    model = Model(good, bad, None, prior, settings)

    def measured(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            x = [model.features(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([column_of(batch, "y"), column_of(batch, "doc_id"), pa.array(x, type=pa.list_(pa.float64()))], names=["y", "doc_id", "x"])

    rows = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in second.mapInArrow(measured, "y int, doc_id long, x array<double>").collect())
    y = np.array([r[1] for r in rows], dtype=float)
    if len(set(y)) < 2:
        return Model(None, None, None, prior, settings)
    importance = np.where(y == 1, prior / y.mean(), (1 - prior) / (1 - y.mean()))
    model.weights = fit_curve(np.array([r[2] for r in rows]), y, importance)
    return model


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs.

    score: 0 to 1, of the whole text; a null text counts as empty, and empty texts are scored like any other. held_out:
    whether the id is in the fold that is never learned from (a null id isn't). Null and repeated ids come out as they
    came in; an empty table gives no rows; other columns aren't read.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(rows):
            yield pa.RecordBatch.from_arrays([column_of(batch, "doc_id"), pa.array([model.score(t) for t in texts_of(batch)], type=pa.float64())], names=["doc_id", "score"])

    modulus, out = model.settings.held_out
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(fold(modulus) == out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= model.settings.threshold).cast("int").alias("predicted"))
