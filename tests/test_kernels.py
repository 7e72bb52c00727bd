import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gablework.model import RansacConfig
from gablework.operators import planes as p
from gablework.operators import triangulate as tr


def roof(n, angle, seed=0, origin=(900_000.0, 6_500_000.0)):
    """Points on both sides of a gable whose ridge runs at y = 5."""
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 12, n), rng.uniform(0, 10, n)
    z = 10 - math.tan(math.radians(angle)) * np.abs(y - 5) + rng.normal(0, 0.02, n)
    return np.stack([x + origin[0], y + origin[1], z], axis=1)


def test_gable_has_two_planes():
    found = p.detect_planes_of(roof(400, 14), 3, RansacConfig())
    normals = sorted(round(float(n[1]), 1) for n, *_ in found[:2])
    assert normals == [-0.2, 0.2] and sum(len(at) for *_, at in found) > 300


def test_steep_planes_need_another_limit():
    steep = roof(400, 45)
    slopes = lambda config: [math.degrees(math.acos(abs(n[2]))) for n, *_ in p.detect_planes_of(steep, 3, config)]
    assert all(s <= 20 for s in slopes(RansacConfig()))
    assert any(abs(s - 45) < 2 for s in slopes(RansacConfig(near_vertical=20.0)))


def test_flat_opposite_planes_merge():
    points = roof(60, 0)
    flat = [(np.array([0.0, 0.0, 1.0]), -10.0, 0.0, np.arange(30)), (np.array([0.0, 0.0, -1.0]), 10.0, 0.0, np.arange(30, 60))]
    assert len(p.merged_planes(points - [900_000.0, 6_500_000.0, 0.0], flat, RansacConfig())) == 1


def test_few_points():
    assert p.detect_planes_of(np.zeros((0, 3)), 1, RansacConfig()) == []
    assert p.detect_planes_of(roof(9, 0), 1, RansacConfig()) == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=3, max_size=25))
def test_hull_holds_all_points(points):
    xy = np.array(points, dtype=float)
    hull = tr.convex_hull_of(xy)
    if len(hull) < 3:
        return
    for a, b in zip(hull, np.roll(hull, -1, axis=0), strict=True):
        assert all(tr._turn(a, b, q) >= -1e-9 for q in xy)


def area(cells):
    return sum(abs(tr._turn(*c)) / 2 for c in cells)


SQUARE = [(0, 0), (10, 0), (10, 8), (0, 8)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.integers(1, 7)), min_size=1, max_size=12, unique=True))
def test_triangles_fill_a_square(points):
    segments = [(x, y, x, y) for x, y in points]
    cells = tr.constrained_cells(SQUARE, segments)
    assert area(cells) == pytest.approx(80)
    assert len(cells) == 2 * (4 + len(points)) - 2 - 4


def test_ridge_becomes_an_edge():
    cells = tr.constrained_cells(SQUARE, [(0, 4, 10, 4)])
    assert area(cells) == pytest.approx(80) and not any(min(c[:, 1]) < 4 - 1e-9 and max(c[:, 1]) > 4 + 1e-9 for c in cells)


def test_crossing_ridges():
    lines = [(1, 1, 9, 7), (1, 7, 9, 1)]
    with pytest.raises(tr.CrossingConstraints):
        tr.constrained_cells(SQUARE, lines)
    assert area(tr.constrained_cells(SQUARE, lines, "split")) == pytest.approx(80)
