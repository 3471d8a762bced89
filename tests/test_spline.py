"""Cubic splines solved in blocks against one solve of the whole system."""

import numpy as np
import pytest

from fusemill.operators import spline

TRAJECTORY = "scene_id int, us long, rx double, ry double, rz double, tx double, ty double, tz double"


def whole(t, y, x, ends):
    """The spline by one dense system over all knots, evaluated at x (inside)."""
    n = len(t)
    h = np.diff(t)
    a, d = np.zeros((n, n)), np.zeros((n, y.shape[1]))
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        d[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, 0] = a[-1, -1] = 1
    if ends == "not-a-knot" and n == 3:
        a[0, :2] = a[-1, -2:] = 1, -1
        a[-1, -2:] = -1, 1
    elif ends == "not-a-knot" and n > 3:
        a[0, :3] = h[1], -(h[0] + h[1]), h[0]
        a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    m = np.linalg.solve(a, d)
    k = np.clip(np.searchsorted(t, x, "right") - 1, 0, n - 2)
    u, v, g = (t[k + 1] - x)[:, None], (x - t[k])[:, None], h[k][:, None]
    return m[k] * u**3 / (6 * g) + m[k + 1] * v**3 / (6 * g) + (y[k] / g - m[k] * g / 6) * u + (y[k + 1] / g - m[k + 1] * g / 6) * v


@pytest.mark.parametrize("ends", ["natural", "not-a-knot"])
@pytest.mark.parametrize("blocks", [1, 50])
def test_blocks_are_the_whole_system(spark, ends, blocks):
    rng = np.random.default_rng(3)
    scenes = {s: np.unique(np.concatenate([[0, 49_999_999], rng.integers(1, 49_999_999, 400)])) for s in (1, 2)}
    scenes |= {3: np.array([5, 4_000_000]), 4: np.array([5, 3_000_000, 4_000_000]), 5: np.array([7, 3_000_000, 4_000_000, 30_000_000]), 6: np.array([9])}
    y = {s: np.cumsum(rng.normal(size=(len(t), 3)), axis=0) for s, t in scenes.items()}
    rows = [(s, int(u), 0.0, 0.0, 0.0, *map(float, y[s][k])) for s, t in scenes.items() for k, u in enumerate(t)]
    trajectory = spark.createDataFrame(rows + rows[:50], TRAJECTORY)
    times = {s: np.unique(np.concatenate([t[:30], t[-3:], rng.integers(-1000, 50_010_000, 300)])) for s, t in scenes.items()}
    asked = spark.createDataFrame([(s, int(u)) for s, t in times.items() for u in t], "scene_id int, us long")
    pieces = spline.spline_pieces(trajectory, ends, block=50_000_000 // blocks)
    assert pieces.where("scene_id = 1").count() >= 398
    got = {(r.scene_id, r.us): (r.tx, r.ty, r.tz) for r in spline.spline_positions(asked, pieces).collect()}
    want = {}
    for s, t in scenes.items():
        if len(t) > 1:
            x = times[s][(times[s] >= t[0]) & (times[s] <= t[-1])]
            want |= {(s, int(u)): v for u, v in zip(x, whole(t / 1e6, y[s], x / 1e6, ends))}
    assert got.keys() == want.keys()
    worst = max(np.abs((np.array(got[k]) - want[k]) / (1 + np.abs(want[k]))).max() for k in want)
    assert worst < 1e-6


def test_cubic_curve_is_met_exactly(spark):
    f = lambda t: (t**3 - 2 * t, 1 - t * t, 4 * t)
    rows = [(0, k * k * 100_000, 0.0, 0.0, 0.1 * k, *map(float, f(k * k / 10))) for k in range(9)]
    asked = spark.createDataFrame([(0, k * 123_457) for k in range(52)], "scene_id int, us long")
    got = spline.cubic_poses(asked, spark.createDataFrame(rows, TRAJECTORY), block=700_000).collect()
    assert len(got) == 52
    for r in got:
        assert np.allclose([r.tx, r.ty, r.tz], f(r.us / 1e6), atol=1e-8) and abs(r.qw**2 + r.qx**2 + r.qy**2 + r.qz**2 - 1) < 1e-9
    with pytest.raises(ValueError):
        spline.spline_pieces(asked, "clamped")


def test_reduction_solves_any_size():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 65, 200):
        lower, upper = rng.normal(size=n), rng.normal(size=n)
        diagonal = np.abs(lower) + np.abs(upper) + rng.uniform(0.5, 2, n)
        right = rng.normal(size=(n, 2))
        full = np.diag(diagonal) + np.diag(upper[:-1], 1) + np.diag(lower[1:], -1)
        assert np.allclose(spline.solve_tridiagonal(lower, diagonal, upper, right), np.linalg.solve(full, right))
