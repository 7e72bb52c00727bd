"""The plane kernel's triples."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import numpy as np
import pytest

from gablework.model import RansacConfig
from gablework.operators import planes


@pytest.mark.parametrize(("n", "seed"), [(3, 0), (10, 3), (15, 14), (149, 15), (461, 33), (50, -1 % 2**64)])
def test_triples_are_many_and_of_three_positions(n, seed):
    got = planes.triples(n, 2000, seed)
    assert got.shape == (2000, 3) and got.min() >= 0 and got.max() < n
    assert all(len(set(t)) == 3 for t in got.tolist()) and (got == planes.triples(n, 2000, seed)).all()
    of, all_of = len({tuple(sorted(t)) for t in got.tolist()}), n * (n - 1) * (n - 2) // 6
    assert of == all_of if all_of <= 120 else of > 0.85 * min(2000, all_of)


def test_every_seed_finds_a_plane_of_ten_points():
    xy = np.random.default_rng(0).random((10, 2)) * 8
    points = np.column_stack([xy, 5 + 0.3 * xy[:, 0]])
    assert all(len(planes.detect_planes_of(points, seed, RansacConfig())) == 1 for seed in range(20))
    assert planes.triples(2, 5, 1).shape == (0, 3)


def brute_round(points, picked, config):
    """The plane of most points, the earliest of them, fitted anew by SVD."""
    best = None
    for a, b, c in picked:
        normal = np.cross(points[b] - points[a], points[c] - points[a])
        if (size := np.linalg.norm(normal)) < 1e-10:
            continue
        normal = normal / size
        if np.degrees(np.arccos(min(1.0, abs(normal[2])))) > 90 - config.near_vertical:
            continue
        held = np.abs((points - points[a]) @ normal) < config.epsilon
        if best is None or held.sum() > best.sum():
            best = held
    centre = points[best].mean(axis=0)
    normal = np.linalg.svd(points[best] - centre)[2][2]
    normal = normal * np.sign(normal[2])
    return normal, np.abs((points - centre) @ normal) < config.epsilon


@pytest.mark.parametrize("seed", range(4))
def test_one_round_equals_brute_force(seed):
    rng, config = np.random.default_rng(seed), RansacConfig()
    points = rng.uniform(0, 10, (60, 3))
    points[:40, 2] = 3 + 0.1 * points[:40, 0] + rng.normal(0, 0.02, 40)
    picked = planes.triples(60, 300, seed)
    normal, _, _, held = planes.ransac_one(points, picked, config)
    expected, inlier = brute_round(points, picked, config)
    assert np.allclose(normal, expected, atol=1e-9) and (held == inlier).all()


def test_detection_peels_rounds_like_brute_force():
    rng, config = np.random.default_rng(5), RansacConfig()
    points = rng.uniform(0, 10, (200, 3))
    points[:90, 2], points[90:160, 2] = 3 + 0.2 * points[:90, 0], 9 - 0.15 * points[90:160, 1]
    local, left, found = points - points.mean(axis=0), np.arange(200), []
    while len(left) >= config.min_points:
        normal, held = brute_round(local[left], planes.triples(len(left), config.max_iterations, 7), config)
        if held.sum() < config.min_points:
            break
        found.append(left[held])
        left = left[~held]
    own = planes.detect_planes_of(points, 7, RansacConfig(merge_angle=-1.0))
    assert len(own) >= 2 and [sorted(at) for *_, at in own] == [sorted(at) for at in found[: len(own)]]


def test_numbered_triples_are_many():
    assert all(len({tuple(t) for t in planes.numbered_triples(n, 2000, 3)[:, 1:].tolist()}) > 0.6 * min(2000, n * (n - 1) * (n - 2)) for n in (40, 200, 600))


def test_merging_absorbs_in_order(spark):
    rows = [(1, 0, 0.0, 0.0, 1.0, -2.0, [(i, float(i % 4), float(i // 4), 2.0) for i in range(12)]),
            (1, 1, 0.0, 0.0, 1.0, -2.2, [(i, float(i % 4), float(i // 4), 2.2) for i in range(20, 32)]),
            (1, 2, 0.0, 0.6, 0.8, -9.0, [(40, 0.0, 0.0, 11.25), (41, 1.0, 0.0, 11.25), (42, 0.0, 4.0, 8.25)]),
            (2, 0, 0.0, 0.0, 1.0, -2.0, [])]
    given = spark.createDataFrame([(*r[:6], 0.0, len(r[6]), r[6]) for r in rows], planes.PLANES_SCHEMA.format(fid="bigint"))
    got = {(r.fid, r.plane_id): r for r in planes.merge_planes(given).collect()}
    assert sorted(got) == [(1, 0), (1, 1), (2, 0)] and got[1, 0].n_inliers == 24 and got[1, 1].n_inliers == 3
    assert [p.pid for p in got[1, 0].inliers] == [*range(12), *range(20, 32)]
    assert abs(got[1, 1].ny - 0.6) < 1e-9 and got[2, 0].n_inliers == 0
