"""Operators that were rebuilt for size: against plain versions, and at sizes that a fold or a join of all can't end."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fusemill.functions.geometry import rigid_inverse, rotvec_to_matrix
from fusemill.operators import boxes, components, depth, frames, instances, lift, masks, vocab, vote
from fusemill.plans.fixtures import Inputs
from fusemill.sources import files

SF = "/root/testdata/sf0.001"
PIXEL = ["scene_id", "frame_id", "px", "py"]
CAMERA = {"fx": 8.0, "fy": 8.0, "cx": 8.0, "cy": 6.0, "width": 16, "height": 12}


@pytest.fixture(scope="module")
def i(spark):
    return Inputs(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- votes ---


def test_votes_taken_back_are_votes_never_cast(spark, i):
    table = vote.vote_table(i.vocab, ["ade20k", "nyu40id", "wn199", "id"], "wn_merged")
    lone = spark.createDataFrame([(9, 9, 0, 0, "m", "wn_merged", 3), (9, 9, 0, 0, "m", "wn_merged", 3), (9, 9, 1, 0, "m", "none", 3), (9, 9, 2, 0, "m", "id", 4), (9, 9, 2, 0, "other", "id", 7)],
        "scene_id int, frame_id int, px int, py int, model string, label_space string, label int")
    pred = i.pred.select(*lone.columns).unionByName(lone)
    models = pred.select("model").distinct()
    variants = models.select(F.col("model").alias("without"), F.col("model").alias("variant")).unionByName(spark.createDataFrame([(None, "all")], "without string, variant string"))
    for least in (1, 2, 3):
        want = vote.vote(vote.exclude_models(pred, variants), table, ["variant", *PIXEL], least)
        got = vote.leave_one_out(pred, table, models, least)
        assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    seen = plan(vote.leave_one_out(i.pred, table, i.model))
    assert "Cartesian" not in seen and "NestedLoop" not in seen.split("Subquery")[0].split("collect_list(struct(n")[0]


def test_tasks_of_a_vote_grow_with_the_votes(spark, i, monkeypatch):
    monkeypatch.setattr(vote, "VOTES_A_TASK", 300)
    table = vote.vote_table(i.vocab, ["ade20k", "nyu40id", "wn199", "id"], "wn_merged")
    for counted in (vote.vote(i.pred, table), vote.vote_state(i.pred, table), vote.vote_state(i.pred, table, truth=i.gt)):
        above, *below = plan(counted).split("Exchange hashpartitioning(scene_id")
        assert len(below) == 1 and "Aggregate" not in below[0]  # of the vocabulary, what is voted for is read
        assert counted.rdd.getNumPartitions() > 8


def test_truth_comes_with_the_votes(spark, i):
    table = vote.vote_table(i.vocab, ["ade20k", "nyu40id", "wn199", "id"], "wn_merged")
    schema = "scene_id int, frame_id int, px int, py int, label int"
    # truth twice, three times with two labels, null, and of pixels that have no voter
    gt = i.gt.select(*PIXEL, "label")
    some = gt.orderBy(*PIXEL).limit(3)
    gt = gt.unionByName(some).unionByName(some.withColumn("label", F.lit(7))).unionByName(spark.createDataFrame([(9, 9, 0, 0, None), (9, 9, 1, 0, 3), (9, 9, None, 0, 3)], schema))
    lone = spark.createDataFrame([(9, 9, 0, 0, "m", "wn_merged", 3), (9, 9, 2, 0, "m", "wn_merged", 3), (9, 9, None, 0, "m", "none", 3)], "scene_id int, frame_id int, px int, py int, model string, label_space string, label int")
    pred = i.pred.select(*lone.columns).unionByName(lone)
    models = pred.select("model").distinct()
    joined = vote.leave_one_out(pred, table, models).withColumnRenamed("label", "p").join(gt.withColumnRenamed("label", "t"), PIXEL)
    want = joined.groupBy("variant", "p", "t").agg(F.count("*").alias("n"))
    got = vote.leave_one_out_counts(pred, table, models, gt)
    assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0
    assert plan(got).count("Exchange hashpartitioning(scene_id") == 1  # none for a join with truth


def test_signatures_give_the_vote(spark, i):
    table = vote.vote_table(i.vocab, ["ade20k", "nyu40id", "wn199", "id"], "wn_merged")
    pred = i.pred.select(*PIXEL, "label_space", "label")
    rows = spark.createDataFrame([(9, 9, 0, 0, "none", 3), (9, 9, 1, 0, "nyu40id", 99), (9, 9, 1, 0, "nyu40id", 99), (9, 9, 2, 0, "wn199", None), (9, 9, 2, 0, "id", 7)], "scene_id int, frame_id int, px int, py int, label_space string, label int")
    for least in (1, 2):
        want, got = (f(pred.unionByName(rows), table, PIXEL, least) for f in (vote.vote, vote.vote_by_signature))
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


# --- visibility ---


def test_cells_lose_no_point_of_turned_cameras(spark):
    rng = np.random.default_rng(2)
    points = pd.DataFrame(rng.normal(size=(3000, 3)) * [6, 3, 1], columns=list("xyz")).assign(scene_id=lambda d: d.index % 2, vertex_id=lambda d: d.index)
    points.loc[:600, ["x", "y", "z"]] = rng.normal(size=(601, 3)) * 0.1 + 2
    frames = pd.DataFrame(rng.normal(size=(60, 6)) * [2, 2, 2, 4, 2, 1], columns=["rx", "ry", "rz", "tx", "ty", "tz"]).assign(scene_id=lambda d: d.index % 2, frame_id=lambda d: d.index)
    points, frames = spark.createDataFrame(points), spark.createDataFrame(frames)
    r = rotvec_to_matrix(F.col("rx"), F.col("ry"), F.col("rz"))
    lit = lambda v: F.lit(float(v))
    pose = F.array(*r[0:3], F.col("tx"), *r[3:6], F.col("ty"), *r[6:9], F.col("tz"), lit(0), lit(0), lit(0), lit(1))
    frames = frames.select("scene_id", "frame_id", pose.alias("pose"))
    want = lift.points_x_frames(points, frames, CAMERA)
    assert want.count() > 1000
    for block in (0.1, 0.7, 50.0):
        got = lift.points_x_frames(points, frames, CAMERA, block)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_pairs_grow_with_what_is_seen(spark):
    # a corridor of 40,000 points in 8,000 blocks; every frame looks along a short piece of it
    points = spark.range(40_000).select(F.lit(0).alias("scene_id"), F.col("id").cast("int").alias("vertex_id"), (F.col("id") * 0.02).alias("x"), (F.col("id") % 3 * 0.1).alias("y"), F.lit(2.0).alias("z"))
    frames = spark.range(200).select(F.lit(0).alias("scene_id"), F.col("id").cast("int").alias("frame_id"), (F.col("id") * 4.0).alias("tx"))
    lit = lambda v: F.lit(float(v))
    pose = F.array(lit(1), lit(0), lit(0), F.col("tx"), lit(0), lit(1), lit(0), lit(0), lit(0), lit(0), lit(1), lit(0), lit(0), lit(0), lit(0), lit(1))
    inverse = frames.withColumn("inv", rigid_inverse(pose)).select("scene_id", "frame_id", *(F.col("inv")[k].alias(m) for k, m in enumerate(lift.INVERSE)))
    tree = lift.cell_tree(points, 0.1, 5)
    sizes = [t.count() for t in tree]
    cover = lift.covering_cells(tree, inverse, CAMERA)
    near = lift.visible_blocks(points, inverse, CAMERA, 0.1, levels=5)
    assert sizes[0] > 5000 and sizes[-1] < 50
    # all pairs would be 200 x sizes[0]; a frame sees 4 of 800 metres
    assert near.count() < 200 * sizes[0] / 100 and cover.count() < near.count() / 2
    assert {r.level for r in cover.select("level").distinct().collect()} > {0}


# --- masks ---


def pieces_of(pixels):
    left, n = set(pixels), 0
    while left:
        todo, n = [left.pop()], n + 1
        while todo:
            x, y = todo.pop()
            for p in [(x + a, y + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
    return n


@pytest.mark.parametrize("tile", [1, 4, 256])
def test_components_by_any_tiles(spark, tile):
    rng = np.random.default_rng(7)
    own = {m: {(int(x), int(y)) for x, y in rng.integers(-20, 20, (int(n), 2))} for m, n in enumerate([1, 5, 300, 600, 900])}
    own[9] = {(x, y) for x in range(40) for y in range(40) if (y % 2 == 0) or (y % 4 == 1 and x == 39) or (y % 4 == 3 and x == 0)}  # one snake
    rows = [(m, x, y) for m, pixels in own.items() for x, y in pixels]
    df = spark.createDataFrame(rows + rows[:20], "m int, px int, py int")
    assert {r.m: r.n_components for r in masks.mask_components(df, ["m"], tile).collect()} == {m: pieces_of(p) for m, p in own.items()}
    assert masks.mask_components(df.limit(0), ["m"], tile).count() == 0


def test_a_mask_of_a_million_runs(spark):
    # 500 upright stripes of 2,000 pixels, every pixel a run, and a bar that ties 101 of them
    stripes = spark.range(1_000_000).select(F.lit(1).alias("m"), (F.col("id") % 500 * 2).cast("int").alias("px"), F.floor(F.col("id") / 500).cast("int").alias("py"))
    bar = spark.range(200).select(F.lit(1).alias("m"), F.col("id").cast("int").alias("px"), F.lit(1500).alias("py"))
    assert [r.n_components for r in masks.mask_components(stripes.unionByName(bar), ["m"]).collect()] == [400]


def test_components_of_a_long_chain(spark):
    edges = spark.range(3000).select(((F.col("id") * 7919) % 3001).alias("a"), (((F.col("id") + 1) * 7919) % 3001).alias("b"))
    got = components.connected(edges.unionByName(spark.createDataFrame([(9000, 9001), (5, 5)], "a long, b long"))).collect()
    assert {r.root for r in got if r.node < 9000} == {0} and {(r.node, r.root) for r in got if r.node >= 9000} == {(9000, 9000), (9001, 9000)} and len(got) == 3003


# --- instances ---


def test_many_instances_on_one_vertex(spark):
    rng = np.random.default_rng(1)
    rows = {(0, k, 77) for k in range(300)} | {(0, int(k), int(v)) for k, v in zip(rng.integers(0, 300, 3000), rng.integers(0, 5000, 3000))} | {(1, 4, 2**40), (1, 5, 2**40 + 1), (1, 4, 2**40 + 1)}
    df = spark.createDataFrame(list(rows), "scene_id int, idx int, vertex_id long")
    held = {}
    for s, k, v in rows:
        held.setdefault((s, k), set()).add(v)
    want = {(s, a, b): n for s, a in held for t, b in held if s == t and (n := len(held[s, a] & held[s, b]))}
    for words in (1, instances.WORDS):
        assert {(r.scene_id, r.i, r.j): r.n for r in instances.mask_overlaps(df, words).collect()} == want


def test_overlaps_meet_by_blocks(spark):
    # 300 masks that share 5,000 vertices: 90,000 pairs a vertex would be 450 million rows
    df = spark.range(5000).select(F.lit(0).alias("scene_id"), F.col("id").alias("vertex_id"), F.explode(F.sequence(F.lit(0), F.lit(299))).alias("idx"))
    got = instances.mask_overlaps(df).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (90_000, 5000, 5000)


def test_thin_masks_of_a_block_meet_by_vertices(spark):
    # 20,000 masks of one vertex each in one block: 400 million pairs of bitmaps for 400 thousand of masks
    df = spark.range(20_000).select(F.lit(0).alias("scene_id"), F.col("id").alias("idx"), (F.col("id") % 1024).alias("vertex_id"))
    got = instances.mask_overlaps(df).agg(F.count("*"), F.min("n"), F.max("n")).first()
    assert tuple(got) == (sum((20_000 // 1024 + (v < 20_000 % 1024)) ** 2 for v in range(1024)), 1, 1)


# --- boxes ---


def box_rows(rng, n, frames, least=1, most=120):
    side = np.exp(rng.uniform(np.log(least), np.log(most), (n, 2)))
    at = rng.uniform(-300, 300, (n, 2))
    frame = rng.integers(0, frames, n)
    return [(int(f), k, float(round(s, 2)), float(x), float(y), float(x + w), float(y + h)) for k, (f, s, (x, y), (w, h)) in enumerate(zip(frame, rng.random(n), at, side))]


BOXES = "frame_id int, box_id int, score double, x0 double, y0 double, x1 double, y1 double"


def iou_of(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    inter = max(w, 0) * max(h, 0)
    area = lambda q: (q[5] - q[3]) * (q[6] - q[4])
    return inter / (area(a) + area(b) - inter) if inter else 0.0


@pytest.mark.parametrize("iou", [0.0, 0.05, 0.5])
def test_boxes_meet_in_grids(spark, iou):
    rows = box_rows(np.random.default_rng(5), 700, 2)
    rows += [(0, 1000 + k, 0.5, 0.0, 0.0, 2.0 ** (k - 3), 2.0 ** (k - 3)) for k in range(9)] + [(1, 2000, 0.9, 5.0, 5.0, 5.0, 9.0), (1, 2001, 0.9, 5.0, 5.0, 4.0, 4.0)]
    got = {(r.frame_id, r.a, r.b): r.iou for r in boxes.box_pairs(spark.createDataFrame(rows, BOXES), iou).collect()}
    good = [r for r in rows if r[5] > r[3] and r[6] > r[4]]
    want = {}
    for x, a in enumerate(good):
        for b in good[x + 1 :]:
            if a[0] == b[0] and (v := iou_of(a, b)) > iou:
                first, second = sorted((a, b), key=lambda q: (-q[2], q[1]))
                want[a[0], first[1], second[1]] = v
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_rounds_are_the_fold(spark):
    rows = box_rows(np.random.default_rng(6), 900, 3, 60, 150)
    # a chain in which every box suppresses the next one, but for those that are out
    rows += [(9, 5000 + k, 1 - k / 100, 4.0 * k, 0.0, 4.0 * k + 10, 10.0) for k in range(40)]
    kept = []
    for frame in {r[0] for r in rows}:
        own = []
        for r in sorted((r for r in rows if r[0] == frame), key=lambda q: (-q[2], q[1])):
            if not any(iou_of(r, k) > 0.3 for k in own):
                own.append(r)
        kept += own
    got = boxes.nms_boxes(spark.createDataFrame(rows, BOXES), 0.3)
    assert sorted(tuple(r) for r in got.select(*(c.split()[0] for c in BOXES.split(", "))).collect()) == sorted(kept)
    apart = spark.createDataFrame([r for r in rows if r[1] in (5000, 5039)], BOXES)
    assert boxes.nms_boxes(apart, 0.3).count() == 2


def test_a_frame_of_a_hundred_thousand_boxes(spark):
    own = spark.range(100_000).select(F.lit(0).alias("frame_id"), F.col("id").cast("int").alias("box_id"), (F.xxhash64("id") % 1000 / 1000.0).alias("score"), (F.col("id") % 1000 * 3.0).alias("x0"), (F.floor(F.col("id") / 1000) * 30.0).alias("y0"))
    own = own.withColumns({"x1": F.col("x0") + 10, "y1": F.col("y0") + 25})
    kept = boxes.nms_boxes(own, 0.3).cache()
    assert 20_000 < kept.count() < 60_000 and boxes.box_pairs(kept, 0.3).isEmpty()


# --- classes of frames and points ---


def test_equal_poses_and_positions_meet_once(spark):
    rng = np.random.default_rng(3)
    points = pd.DataFrame(rng.integers(-4, 5, (4000, 3)) * [0.3, 0.2, 0.1] + [0, 0, 2], columns=list("xyz")).assign(scene_id=lambda d: d.index % 2, vertex_id=lambda d: d.index)
    points = spark.createDataFrame(points).unionByName(spark.createDataFrame([(None, 0.0, 2.0, 0, 9000)], "x double, y double, z double, scene_id long, vertex_id long"))
    lit = lambda v: F.lit(float(v))
    pose = F.array(lit(1), lit(0), lit(0), F.col("frame_id") % 7 * 0.1, lit(0), lit(1), lit(0), lit(0), lit(0), lit(0), lit(1), lit(0), lit(0), lit(0), lit(0), lit(1))
    frames = spark.range(400).select((F.col("id") % 2).alias("scene_id"), F.col("id").cast("int").alias("frame_id")).withColumn("pose", pose)
    seen = lift.places_x_views(points, frames, CAMERA, 0.5)
    assert seen.count() <= 14 * 729  # not 400 frames x 4,000 points
    plain = lift.points_x_frames(points, frames, CAMERA).cache()
    whole = lift.expand_seen(seen, points, frames)
    assert whole.count() == plain.count() and whole.exceptAll(plain.select(whole.columns)).count() == 0

    grid = frames.select("scene_id", "frame_id", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("px")).select("*", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("py"))
    grid = grid.where("(frame_id + px * py) % 11 <> 0")
    depth, labels = grid.withColumn("depth_m", F.pmod(F.hash("px", "py", "frame_id"), F.lit(5)) * 0.1 + 1.8), grid.withColumn("label", F.pmod(F.hash("frame_id", "px"), F.lit(4)))
    pixels, looked = lift.seen_pixels(depth, labels, frames), plain.join(depth, PIXEL).join(labels, PIXEL).cache()
    near = looked.where("abs(z - depth_m) <= 0.1")
    best = near.groupBy("scene_id", "vertex_id", "label").count().groupBy("scene_id", "vertex_id").agg(F.max(F.struct("count", -F.col("label"))).alias("b"))
    voted = points.join(best, ["scene_id", "vertex_id"], "left").selectExpr("scene_id", "vertex_id", "coalesce(-b.col2, 0)", "coalesce(b.count, 0)")
    for got, want in (
        (lift.seen_by_frame(seen, frames, 16), plain.groupBy("scene_id", "frame_id").agg(F.count("*"), F.sum(F.col("vertex_id") * (F.col("px") + 16 * F.col("py"))))),
        (lift.seen_by_label(seen, pixels), looked.groupBy("scene_id", "frame_id", "label").agg(F.count("*"), F.sum("vertex_id"))),
        (lift.lift_votes(points, seen, pixels), voted),
        (lift.splat_points(seen, pixels, points.select("scene_id", "vertex_id", "x")), near.groupBy(*PIXEL).agg(F.max("vertex_id").alias("vertex_id")).join(points.select("scene_id", "vertex_id", "x"), ["scene_id", "vertex_id"])),
    ):
        rows = sorted(map(tuple, got.collect()))
        assert rows and rows == sorted(map(tuple, want.collect()))


# --- joins whose sides grow by an explode ---


def test_frames_meet_the_axes_of_another_size(spark, i):
    for size in ((24, 8), (5, 30)):
        rows = i.gt.where("k % 5 <> 0")
        held = {(r.scene_id, r.frame_id, r.px, r.py): r.label for r in rows.collect()}
        frames_ = {k[:2] for k in held}
        want = {(*f, x, y): held[*f, x * 16 // size[0], y * 12 // size[1]] for f in frames_ for x in range(size[0]) for y in range(size[1]) if (*f, x * 16 // size[0], y * 12 // size[1]) in held}
        got = frames.resample_nearest(rows, "label", (16, 12), size)
        assert {(r.scene_id, r.frame_id, r.px, r.py): r.label for r in got.collect()} == want
        # no side of a join is a raster of all frames
        assert "Generate" not in plan(got)


def test_key_sets_are_distinct_before_they_meet(spark):
    a = spark.range(1000).select((F.col("id") % 3).alias("k"))
    got = frames.check_key_sets(a, a.where("k > 0").unionByName(spark.createDataFrame([(7,)], "k long")), ["k"])
    assert sorted(map(tuple, got.collect())) == [(0, "left"), (7, "right")]
    initial = plan(frames.check_key_sets(a, a, ["k"])).split("Initial Plan")[-1]
    assert initial.count("HashAggregate") >= 8  # two for each side of both joins


def test_cells_of_boxes_are_not_broadcast(spark):
    rows = spark.createDataFrame(box_rows(np.random.default_rng(8), 400, 2), BOXES)
    for iou in (0.0, 0.1):
        pairs = boxes.box_pairs(rows, iou)
        assert pairs.count() > 0 and "Broadcast" not in plan(pairs)


def test_fit_that_meets_integers(spark):
    # depth is 3 x mono + 7 to the last pixel: the fit returns it, not one less
    rows = spark.range(200_000).select(F.floor(F.col("id") / 190).cast("int").alias("frame_id"), (F.xxhash64("id") % 2500 + 3000).cast("int").alias("mono")).withColumn("scene_id", F.lit(0))
    got = depth.fit_affine_depth(rows.withColumn("depth_mm", F.col("mono") * 3 + 7))
    assert got.where("fitted <> depth_mm or fitted is null").count() == 0


# --- files ---


def test_folders_are_written_by_many_tasks(spark, tmp_path):
    rows = spark.range(60).select(F.col("id").alias("frame_id"), F.col("id").cast("string").alias("value"))
    files.by_folder(rows, "frame_id").text(f"file://{tmp_path}/f")
    written = list((tmp_path / "f").glob("frame_id=*/part-*"))
    assert len(written) == 60 and len({w.name.split("-")[1] for w in written}) > 4
    assert {(r.frame_id, r.value) for r in spark.read.text(f"file://{tmp_path}/f").collect()} == {(k, str(k)) for k in range(60)}


def test_no_scene_is_one_row_of_metadata(spark):
    frames_ = spark.range(500).select(F.lit(0).alias("scene_id"), F.col("id").cast("int").alias("frame_id"), F.array(*(F.lit(float(k)) for k in range(16))).alias("pose"))
    bounds = spark.createDataFrame([(0, 2.0, 1.0, 2.0, 3.0), (5, 1.0, 0.0, 0.0, 0.0)], "scene_id int, scale double, center_x double, center_y double, center_z double")
    classes = spark.createDataFrame([(1, "a", [1, 2, 3])], "id int, name string, color array<int>")
    shares = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (5, 1, 1.0)], "scene_id int, label int, share double")
    got = files.training_meta(frames_, bounds, classes, shares, CAMERA, {"rgb": "rgb"})
    assert {(r.scene_id, r.part): r["count"] for r in got.groupBy("scene_id", "part").count().collect()} == {(0, "scene"): 1, (0, "class"): 2, (0, "frame"): 500}
    assert max(len(r.meta) for r in got.collect()) < 500
