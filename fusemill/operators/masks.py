"""Pixel masks: area, boxes, dilation, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fusemill.operators.components import connected
from fusemill.sources.files import stored

#: Edge of the squares that a mask is cut into.
TILE = 256


def mask_area_bbox(masks: DataFrame, by: list[str]) -> DataFrame:
    """by, area, x0, y0, x1, y1."""
    return masks.groupBy(*by).agg(F.count("*").alias("area"), F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))


def binary_dilate(masks: DataFrame, by: list[str], width: int, height: int) -> DataFrame:
    """masks grown by the four neighbours, within the image."""
    shift = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))))
    grown = masks.select(*by, "px", "py", F.explode(shift).alias("d")).select(*by, (F.col("px") + F.col("d.x")).alias("px"), (F.col("py") + F.col("d.y")).alias("py"))
    return grown.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)).distinct()


def _tile_pieces(t: pa.Table, by: list[str], tile: int) -> pa.Table:
    """A row for each piece of a tile's pixels (touching by side or corner), with its pixels on the tile's edge.

    Pixels become runs of a row, and a sweep over two neighbouring rows ties the runs that touch.
    """
    x, y = t["px"].to_numpy().astype(np.int64), t["py"].to_numpy().astype(np.int64)
    order = np.lexsort((x, y))
    x, y = x[order], y[order]
    new = np.concatenate([[True], (np.diff(y) != 0) | (np.diff(x) > 1)])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x)) - 1
    rows, first, last = y[begin].tolist(), x[begin].tolist(), x[end].tolist()
    root = list(range(len(rows)))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    above = 0
    for k in range(len(rows)):
        # the runs before above lie in earlier rows, or end before this one touches them
        while above < k and (rows[above] < rows[k] - 1 or (rows[above] == rows[k] - 1 and last[above] < first[k] - 1)):
            above += 1
        at = above
        while at < k and rows[at] == rows[k] - 1 and first[at] <= last[k] + 1:
            a, b = find(at), find(k)
            root[max(a, b)] = min(a, b)
            at += 1
    piece = np.array([find(k) for k in range(len(rows))])[np.cumsum(new) - 1]
    edge = (x % tile == 0) | (x % tile == tile - 1) | (y % tile == 0) | (y % tile == tile - 1)
    names = np.unique(piece)
    inside = np.flatnonzero(edge)
    inside = inside[np.argsort(piece[inside], kind="stable")]
    cuts = np.append(np.searchsorted(piece[inside], names), len(inside)).astype(np.int32)
    pixels = lambda v: pa.ListArray.from_arrays(pa.array(cuts), pa.array(v[inside]))
    return pa.table({**{c: pa.array(np.full(len(names), t[c][0].as_py(), np.int64)) for c in by}, "xs": pixels(x), "ys": pixels(y)})


def mask_pieces(masks: DataFrame, by: list[str], tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Pieces (by, node, xs, ys) of each tile of each mask, with their pixels on the tile's edge, and the pairs (a, b) of pieces that touch across tiles."""
    longs = [F.col(c).cast("long").alias(c) for c in by]
    tiles = masks.select(*longs, F.col("px").cast("long").alias("px"), F.col("py").cast("long").alias("py")).distinct()
    tiles = tiles.withColumns({"tx": F.floor(F.col("px") / tile), "ty": F.floor(F.col("py") / tile)})
    kinds = ", ".join(f"{c} long" for c in by) + ", xs array<long>, ys array<long>"
    pieces = tiles.groupBy(*by, "tx", "ty").applyInArrow(lambda t: _tile_pieces(t, by, tile), kinds)
    pieces = stored(pieces.withColumn("node", F.monotonically_increasing_id()), "mask-pieces")
    edge = pieces.select(*by, "node", F.explode(F.arrays_zip("xs", "ys")).alias("p")).select(*by, "node", F.col("p.xs").alias("px"), F.col("p.ys").alias("py"))
    # half of the neighbours, so that a pair is met once
    step = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    beside = edge.select(*by, F.col("node").alias("a"), "px", "py", F.explode(step).alias("d")).select(*by, "a", (F.col("px") + F.col("d.x")).alias("px"), (F.col("py") + F.col("d.y")).alias("py"))
    pairs = beside.join(edge.withColumnRenamed("node", "b"), [*by, "px", "py"]).where("a <> b").select("a", "b")
    return pieces, pairs.distinct()


def mask_components(masks: DataFrame, by: list[str], tile: int = TILE) -> DataFrame:
    """by (integers), n_components: pieces that touch by side or corner.

    A mask is cut into square tiles, and a task sees one tile. Pieces that touch
    across tiles are joined by their pixels on the tiles' edges, and their
    components are found by joins; masks within one tile need no such round.
    """
    pieces, pairs = mask_pieces(masks, by, tile)
    pairs = stored(pairs, "mask-pairs")
    if pairs.isEmpty():
        return pieces.groupBy(*by).agg(F.count("*").alias("n_components"))
    roots = pieces.join(connected(pairs), "node", "left").where("root is null or root = node")
    return roots.groupBy(*by).agg(F.count("*").alias("n_components"))


def fragment_filter(masks: DataFrame, by: list[str], most: int = 30) -> DataFrame:
    """masks with fewer than most components."""
    return masks.join(mask_components(masks, by).where(F.col("n_components") < most), by, "left_semi")


def label_areas(labels: DataFrame) -> DataFrame:
    """scene_id, frame_id, label, area."""
    return labels.groupBy("scene_id", "frame_id", "label").agg(F.count("*").alias("area"))
