"""Rows that repeat an id among a query's nearest."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import numpy as np
import pandas as pd

from gablework.llm.ann import _search


def test_repeats_leave_room_for_the_tenth():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 8))
    ids = np.array([*range(40), *range(5), *range(5)], dtype=np.int64)
    x = np.concatenate([base, base[:5] + 0.01, base[:5] - 0.02])
    q = base[:12] + 0.1
    left, right = pd.DataFrame({"vec_id": ids, "embedding": list(x)}), pd.DataFrame({"query_id": np.arange(100, 112), "query": list(q)})
    got = _search(10)(None, left, right)
    for i in range(12):
        far = pd.Series(np.sqrt(((x - q[i]) ** 2).sum(axis=1))).groupby(ids).min()
        near = far.sort_values().head(10)
        own = got[got["query_id"] == 100 + i]
        assert list(own["vec_id"]) == list(near.index) and np.allclose(own["score"], near)
