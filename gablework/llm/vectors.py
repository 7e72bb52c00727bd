"""Rules that the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def is_usable(column: str) -> Column:
    """Not null, not empty, every component finite, not all zero."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    c = F.col(column)
    return F.coalesce(c.isNotNull() & F.forall(c, finite) & F.exists(c, lambda x: x != 0), F.lit(False))


def matrix(values) -> np.ndarray:
    """A series of vectors as rows of doubles."""
    return np.stack([np.asarray(v, dtype=np.float64) for v in values]) if len(values) else np.zeros((0, 0))


def rows_of(lists: pa.Array) -> np.ndarray:
    """A column of vectors of one length, without nulls, as rows of doubles."""
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def at_one(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component to between a half and one: exact, and no square leaves the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in pairs; where squares would leave the range of doubles, by way of scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        gap = x - y
        most = np.abs(gap).max(axis=1, initial=0.0)
        out = np.sqrt((gap * gap).sum(axis=1))
        odd = np.flatnonzero((most > 1e140) | ((most < 1e-140) & (most > 0)))
        if len(odd):
            half = x[odd] / 2 - y[odd] / 2 if np.isinf(most[odd]).any() else gap[odd] / 2
            power = np.frexp(np.abs(half).max(axis=1))[1]
            half = np.ldexp(half, -power[:, None])
            out[odd] = np.ldexp(np.sqrt((half * half).sum(axis=1)), power + 1)
    return out
