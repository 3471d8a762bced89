"""Scored boxes: conversion, overlap, greedy suppression, tags."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fusemill.functions.geometry import box_iou
from fusemill.sources.files import stored

CORNERS = ("x0", "y0", "x1", "y1")


def absolute_boxes(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Relative centre and size as absolute corners."""
    at = {"x": ("cx", "w", width), "y": ("cy", "h", height)}
    out = {f"{a}{k}": (F.col(c) + sign * F.col(s) / 2) * n for a, (c, s, n) in at.items() for k, sign in ((0, -1), (1, 1))}
    return boxes.withColumns(out)


def _cells(box: str, level: Column) -> Column:
    """The cells (of edge 2 ** level) that a box lies in: four at most where the edge is no shorter than the box."""
    edge = F.pow(F.lit(2.0), level)
    low = {c: F.floor(F.col(box)[f"{c}0"] / edge) for c in "xy"}
    high = {c: F.floor(F.col(box)[f"{c}1"] / edge) for c in "xy"}
    return F.flatten(F.transform(F.sequence(low["x"], high["x"]), lambda x: F.transform(F.sequence(low["y"], high["y"]), lambda y: F.struct(level.alias("level"), x.alias("x"), y.alias("y")))))


def box_pairs(boxes: DataFrame, iou: float) -> DataFrame:
    """frame_id, a, b, iou of two boxes of a frame that overlap by more than iou; a before b by falling score, then id.

    Boxes meet in cells of a grid whose edge is the larger box's size, rounded up to
    a power of two. An overlap above iou bounds the ratio of both sizes by it, so a
    box enters the grids of few sizes above its own. A pair counts in the cell that
    holds the lower corner of what it shares. Without a bound (iou of 0) boxes meet by frame.
    """
    one = boxes.select("frame_id", F.struct("box_id", "score", *CORNERS).alias("p")).where("p.x1 > p.x0 and p.y1 > p.y0")
    size = F.greatest(F.col("p.x1") - F.col("p.x0"), F.col("p.y1") - F.col("p.y0"))
    one = one.withColumn("own", F.ceil(F.log2(size)).cast("int"))
    p, q = F.col("p"), F.col("q")
    meet = (p["x0"] < q["x1"]) & (q["x0"] < p["x1"]) & (p["y0"] < q["y1"]) & (q["y0"] < p["y1"])
    # p is the larger box by its grid, or the first of two of one grid
    first = (p["score"] > q["score"]) | ((p["score"] == q["score"]) & (p["box_id"] < q["box_id"]))
    if iou > 0:
        up = F.sequence(F.col("own"), F.col("own") + math.ceil(math.log2(1 / iou)) + 1)
        left = one.select("frame_id", "p", "own", F.explode(_cells("p", F.col("own"))).alias("cell"))
        right = one.select("frame_id", F.col("p").alias("q"), F.col("own").alias("q_own"), F.explode(F.flatten(F.transform(up, lambda k: _cells("p", k)))).alias("cell"))
        # a box has many cells, which its table's size doesn't tell: without the hint the cells of all boxes may be broadcast
        pairs = left.join(right.hint("merge"), ["frame_id", "cell"]).where(meet & ((F.col("own") > F.col("q_own")) | first))
        edge = F.pow(F.lit(2.0), F.col("cell.level"))
        for c in "xy":
            pairs = pairs.where(F.floor(F.greatest(p[f"{c}0"], q[f"{c}0"]) / edge) == F.col("cell")[c])
    else:
        pairs = one.join(one.withColumnRenamed("p", "q").drop("own").hint("merge"), "frame_id").where(meet & first)
    value = box_iou({c: p[c] for c in CORNERS}, {c: q[c] for c in CORNERS})
    a, b = F.when(first, p["box_id"]).otherwise(q["box_id"]), F.when(first, q["box_id"]).otherwise(p["box_id"])
    return pairs.select("frame_id", a.alias("a"), b.alias("b"), value.alias("iou")).where(F.col("iou") > iou)


def nms_boxes(boxes: DataFrame, iou: float = 0.5) -> DataFrame:
    """boxes that greedy suppression keeps: by falling score, a box goes if a kept one overlaps it by more than iou.

    All frames are settled in rounds: a box that no live box comes before stays, and
    takes those that it overlaps out; the overlaps of what went out are gone. That is
    what a fold by falling score keeps, without a fold: no frame is one task's work.
    """
    live = stored(box_pairs(boxes, iou).select("frame_id", "a", "b"), "overlaps")
    gone = None
    while not live.isEmpty():
        beaten = live.select("frame_id", F.col("b").alias("a")).distinct()
        out = stored(live.join(beaten, ["frame_id", "a"], "left_anti").select("frame_id", F.col("b").alias("box_id")).distinct(), "suppressed")
        gone = out if gone is None else gone.unionByName(out)
        for side in ("a", "b"):
            live = live.join(out.withColumnRenamed("box_id", side), ["frame_id", side], "left_anti")
        live = stored(live, "overlaps")
    return boxes if gone is None else boxes.join(gone, ["frame_id", "box_id"], "left_anti")


def best_tag_per_box(tokens: DataFrame, threshold: float = 0.2) -> DataFrame:
    """frame_id, box_id, tag, score: of the tokens above threshold that aren't separators, the best tag; ties to the first tag; boxes without one are dropped."""
    tags = tokens.where((F.col("score") > threshold) & ~F.col("separator")).groupBy("frame_id", "box_id", "tag").agg(F.max("score").alias("score"))
    best = tags.groupBy("frame_id", "box_id").agg(F.max(F.struct("score", (-F.col("tag")).alias("t"))).alias("b"))
    return best.select("frame_id", "box_id", (-F.col("b.t")).alias("tag"), F.col("b.score").alias("score"))
