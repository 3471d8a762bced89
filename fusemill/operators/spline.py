"""Cubic splines through trajectories, solved across tasks.

The second derivatives at a scene's knots are the solution of a tridiagonal
system. Knots are cut into blocks by time. A block is solved alone, for its own
right sides and for what the last knot before it and the first one after it bring
in; what is left is a system of one row a block, whose solution is put back into
every block. So a trajectory of any length is many tasks' work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.operators.sync import BUCKET, beside, bracket_pose, interpolate_pose
from fusemill.sources.files import stored

AXES = ("tx", "ty", "tz")
#: Microseconds of a scene that are one block of the system.
BLOCK = 60_000_000
SECOND = 1e6


def solve_tridiagonal(lower: np.ndarray, diagonal: np.ndarray, upper: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solutions for each column of right, by parallel cyclic reduction: every step doubles the distance to the rows that a row still depends on."""
    scale = diagonal.copy()
    lower, upper, right, diagonal = lower / scale, upper / scale, right / scale[:, None], np.ones(len(scale))
    lower[:1], upper[-1:] = 0, 0
    step = 1
    while step < len(scale):
        back = lambda x, fill: np.concatenate([np.full((step, *x.shape[1:]), fill), x[:-step]])
        on = lambda x, fill: np.concatenate([x[step:], np.full((step, *x.shape[1:]), fill)])
        a, c = -lower / back(diagonal, 1.0), -upper / on(diagonal, 1.0)
        diagonal = diagonal + a * back(upper, 0.0) + c * on(lower, 0.0)
        right = right + a[:, None] * back(right, 0.0) + c[:, None] * on(right, 0.0)
        lower, upper = a * back(lower, 0.0), c * on(upper, 0.0)
        step *= 2
    return right / diagonal[:, None]


def _system(trajectory: DataFrame, ends: str, bucket: int) -> DataFrame:
    """One row a knot with an unknown second derivative: its equation, its piece of the curve, and whether it is the last one."""
    knots = trajectory.groupBy("scene_id", "us").agg(F.min(F.struct(*AXES)).alias("at")).select("scene_id", "us", "at.*")
    whole = knots.groupBy("scene_id").agg(F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n_knots"))
    rows = beside(knots, knots, (True, True), bucket).join(whole.where("n_knots > 1"), "scene_id")
    free = F.lit(ends == "not-a-knot") & (F.col("n_knots") > 2)
    rows = rows.where(~free | (F.col("b").isNotNull() & F.col("a").isNotNull()))
    rows = rows.withColumns({"h0": (F.col("us") - F.col("b.us")) / SECOND, "h1": (F.col("a.us") - F.col("us")) / SECOND})
    h0, h1 = F.col("h0"), F.col("h1")
    edge = h0.isNull() | h1.isNull()
    # with three knots left free at both ends the curve is one parabola
    second, before_last = free & (F.col("b.us") == F.col("first")), free & (F.col("a.us") == F.col("last"))
    pick = lambda plain, at_start, at_end, both, end: F.when(edge, end).when(second & before_last, both).when(second, at_start).when(before_last, at_end).otherwise(plain)
    zero = F.lit(0.0)
    bands = {
        "lower": pick(h0, zero, h0 - h1 * h1 / h0, zero, zero),
        "diagonal": pick(2 * (h0 + h1), 2 * (h0 + h1) + h0 + h0 * h0 / h1, 2 * (h0 + h1) + h1 + h1 * h1 / h0, 3 * (h0 + h1), F.lit(1.0)),
        "upper": pick(h1, h1 - h0 * h0 / h1, zero, zero, zero),
    }
    right = {f"d_{c}": F.when(edge, 0.0).otherwise(6 * ((F.col("a")[c] - F.col(c)) / h1 - (F.col(c) - F.col("b")[c]) / h0)) for c in AXES}
    out = rows.withColumns(bands | right)
    begins = F.when(free & (F.col("b.us") == F.col("first")), F.col("first")).otherwise(F.col("us"))
    final = F.when(free, F.col("a.us") == F.col("last")).otherwise(F.col("a").isNull())
    parabola = free & (F.col("n_knots") == 3)
    following = [F.col("a")[c].alias(f"next_{c}") for c in AXES]
    return out.select(
        "scene_id", "us", *AXES, F.col("a.us").alias("next_us"), *following, begins.alias("begins"), "last", final.alias("final"), parabola.alias("parabola"), *bands, *right
    )


#: What a block's solution is for the knot, and for the one after it: its own part, and the shares of the knots before and after the block.
PARTS = [f"{k}_{c}" for k in ("own", "then") for c in (*AXES, "left", "right")]


def _solved(t: pa.Table) -> pa.Table:
    """A block's rows in order of time with PARTS."""
    t = t.sort_by("us")
    lower, diagonal, upper = (t[c].to_numpy().copy() for c in ("lower", "diagonal", "upper"))
    right = np.zeros((len(lower), 5))
    for k, c in enumerate(AXES):
        right[:, k] = t[f"d_{c}"].to_numpy()
    right[0, 3], right[-1, 4] = -lower[0], -upper[-1]
    own = solve_tridiagonal(lower, diagonal, upper, right)
    # the knot after a block's last one is the first one of the next block
    then = np.concatenate([own[1:], [[0.0, 0.0, 0.0, 0.0, 1.0]]])
    for k, name in enumerate(PARTS):
        t = t.append_column(name, pa.array(own[:, k] if k < 5 else then[:, k - 5]))
    return t


def _joined(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second derivatives on both sides of each of a scene's blocks, from one row a block."""
    t = pa.Table.from_batches(batches).sort_by("k")
    n = t.num_rows
    get = lambda end, names: np.array([t[f"{end}_{c}"].to_numpy() for c in names]).T
    first, last, (ql, rl), (qf, rf) = get("f", AXES), get("l", AXES), get("l", ("left", "right")).T, get("f", ("left", "right")).T
    # forward: a block's last value as a + b times the next block's first one
    a, b = np.zeros((n + 1, 3)), np.zeros(n + 1)
    for k in range(n):
        share = 1 - qf[k] * b[k]
        begin, on = (first[k] + qf[k] * a[k]) / share, rf[k] / share
        a[k + 1], b[k + 1] = last[k] + ql[k] * (a[k] + b[k] * begin), ql[k] * b[k] * on + rl[k]
    after, before = np.zeros((n, 3)), np.zeros((n, 3))
    begin = np.zeros(3)
    for k in range(n - 1, -1, -1):
        after[k] = begin
        begin = (first[k] + qf[k] * a[k] + rf[k] * begin) / (1 - qf[k] * b[k])
        before[k] = a[k] + b[k] * begin
    columns = [t["scene_id"].combine_chunks(), t["k"].combine_chunks(), *(pa.array(before[:, k]) for k in range(3)), *(pa.array(after[:, k]) for k in range(3))]
    yield pa.RecordBatch.from_arrays(columns, ["scene_id", "k", *(f"before_{c}" for c in AXES), *(f"after_{c}" for c in AXES)])


def spline_pieces(trajectory: DataFrame, ends: str = "not-a-knot", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """scene_id, us (where a piece begins), last (where the scene ends), and each piece's two knots with their second derivatives.

    trajectory: scene_id, us, tx, ty, tz; of rows with one time the least counts. ends: natural (no curvature
    at the ends), or not-a-knot (the second knot and the last but one leave no mark). Two knots make a line,
    and one makes nothing.
    """
    if ends not in ("natural", "not-a-knot"):
        raise ValueError(f"ends {ends!r}: natural or not-a-knot")
    rows = _system(trajectory, ends, bucket).withColumn("k", F.floor(F.col("us") / block).cast("long"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + "".join(f", {p} double" for p in PARTS)
    solved = stored(rows.groupBy("scene_id", "k").applyInArrow(_solved, kinds), "spline-blocks")
    edge = [F.min_by(f"own_{c}", "us").alias(f"f_{c}") for c in (*AXES, "left", "right")] + [F.max_by(f"own_{c}", "us").alias(f"l_{c}") for c in (*AXES, "left", "right")]
    kind = rows.schema["scene_id"].dataType.simpleString()
    sides = ", ".join(f"{s}_{c} double" for s in ("before", "after") for c in AXES)
    joined = solved.groupBy("scene_id", "k").agg(*edge).groupBy("scene_id").applyInArrow(_joined, f"scene_id {kind}, k long, {sides}")
    # one row a block, and read by every row of the block: written, so that the join sees its size
    out = solved.join(stored(joined, "spline-joints"), ["scene_id", "k"]).where(~F.col("final") | F.col("parabola"))

    def bend(part: str, c: str) -> Column:
        return F.col(f"{part}_{c}") + F.col(f"{part}_left") * F.col(f"before_{c}") + F.col(f"{part}_right") * F.col(f"after_{c}")

    bends = [bend("own", c).alias(f"m0_{c}") for c in AXES] + [F.when(F.col("parabola"), bend("own", c)).otherwise(bend("then", c)).alias(f"m1_{c}") for c in AXES]
    return out.select("scene_id", F.col("begins").alias("us"), "last", F.col("us").alias("t0"), F.col("next_us").alias("t1"), *AXES, *(f"next_{c}" for c in AXES), *bends)


def spline_positions(times: DataFrame, pieces: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """scene_id, us, tx, ty, tz of the times (scene_id, us) that lie within their scene's trajectory."""
    found = beside(times.select("scene_id", "us").distinct(), pieces, (False, False), bucket).where("b is not null").select("scene_id", "us", "b")
    found = found.where(F.col("us") <= F.col("b.last"))
    p = lambda c: F.col("b")[c]
    h, on, left = (p("t1") - p("t0")) / SECOND, (F.col("us") - p("t0")) / SECOND, (p("t1") - F.col("us")) / SECOND
    found = found.withColumns({"h": h, "on": on, "left": left})
    h, on, left = F.col("h"), F.col("on"), F.col("left")
    at = [
        (p(f"m0_{c}") * left**3 / (6 * h) + p(f"m1_{c}") * on**3 / (6 * h) + (p(c) / h - p(f"m0_{c}") * h / 6) * left + (p(f"next_{c}") / h - p(f"m1_{c}") * h / 6) * on).alias(c)
        for c in AXES
    ]
    return found.select("scene_id", "us", *at)


def cubic_poses(times: DataFrame, trajectory: DataFrame, ends: str = "not-a-knot", block: int = BLOCK, bucket: int = BUCKET) -> DataFrame:
    """scene_id, us, tx, ty, tz, qw, qx, qy, qz: translation by cubic spline, rotation spherical between the two neighbours."""
    turned = interpolate_pose(bracket_pose(times, trajectory, bucket)).drop(*AXES)
    moved = spline_positions(times, spline_pieces(trajectory, ends, block, bucket), bucket)
    return moved.join(turned, ["scene_id", "us"])
