"""Worked cases of the rules that change results, properties, and the shape of plans."""

import math

import pytest
from pyspark.sql import functions as F

from fusemill.functions import geometry as G
from fusemill.operators import boxes, depth, evaluate, frames, instances, lift, masks, sync, vocab, vote
from fusemill.plans import catalog
from fusemill.plans.fixtures import Inputs
from fusemill.sources import files
from fusemill.streaming import confusion

SF = "/root/testdata/sf0.001"
PIXEL = ["scene_id", "frame_id", "px", "py"]


@pytest.fixture(scope="module")
def i(spark):
    return Inputs(spark, SF)


def pred(spark, rows):
    return spark.createDataFrame([(0, 0, px, 0, m, s, f"m{m}", l) for px, m, s, l in rows], "scene_id int, frame_id int, px int, py int, model_no int, label_space string, model string, label int")


def table(spark, rows):
    return spark.createDataFrame(rows, "label_space string, label int, candidate int")


def test_vote_ties_and_uncovered_pixels(spark):
    t = table(spark, [("a", 1, 7), ("a", 2, 3), ("a", 4, 5), ("a", 4, 6)])
    p = pred(spark, [(0, 0, "a", 1), (0, 1, "a", 2), (0, 2, "a", 1), (0, 3, "a", 2), (1, 0, "a", 99), (2, 0, "a", 1), (3, 0, "a", 4), (3, 1, "a", 4)])
    got = {r.px: (r.n_votes, r.label) for r in vote.vote(p, t).collect()}
    assert got == {0: (2, 3), 1: (0, 0), 2: (1, 0), 3: (2, 5)}


def test_vote_domain(spark):
    p = pred(spark, [(0, 0, "ade20k", 150), (1, 0, "ade20k", 149), (2, 0, "nyu40id", 0), (3, 0, "wn199", 189), (4, 0, "id", 1191)])
    assert sorted(r.px for r in vote.vote_domain(p).collect()) == [1, 4]


def test_voting_ignores_order_and_repeats(i):
    t = vote.vote_table(i.vocab, ["ade20k", "nyu40id", "wn199", "id"], "wn_merged")
    once = {tuple(r[:4]): r.label for r in vote.vote(i.pred, t, min_votes=1).collect()}
    turned = i.pred.withColumn("model_no", 5 - F.col("model_no")).orderBy(F.rand(1))
    assert {tuple(r[:4]): r.label for r in vote.vote(turned, t, min_votes=1).collect()} == once
    assert {tuple(r[:4]): r.label for r in vote.vote(i.pred.unionByName(i.pred), t, min_votes=1).collect()} == once


def test_ambiguous_miss_counts_for_each_target(spark):
    counts = spark.createDataFrame([(1, 10, 5), (1, 30, 2), (2, 10, 4), (None, 10, 3), (3, None, 9)], "pred_id int, label_id int, n long")
    pairs = spark.createDataFrame([(1, 10), (1, 20)], "l int, r int")
    got = {(r.pred_id, r.label_id): r.n for r in evaluate.match_confmat(counts, pairs).collect()}
    assert got == {(10, 10): 5, (10, 30): 2, (20, 30): 2, (None, 10): 7}


def test_class_without_truth_is_left_out(spark):
    matched = spark.createDataFrame([(1, 1, 6), (2, 1, 2), (None, 1, 2)], "pred_id int, label_id int, n long")
    by = {r.class_id: r for r in evaluate.class_metrics(matched).collect()}
    assert by[2].iou is None and by[2].n_truth == 0 and by[1].iou == 0.6
    m = evaluate.segmentation_metrics(matched).first()
    assert (m.m_iou, m.m_acc, m.t_acc) == (0.6, 0.6, 0.6)


def test_match_labels_beyond_the_table(spark):
    v = spark.createDataFrame([(0, "1", "5"), (1, "2", None)], "row_idx int, a string, b string")
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (99, 5), (-1, 5)], "l int, r int")
    got = {(r.l, r.r): r.match for r in vocab.match_labels(rows, "l", "r", v, "a", "b", True).collect()}
    assert got == {(1, 5): 1, (1, 6): -1, (2, 5): -1, (99, 5): -1, (-1, 5): -1}


def test_projection_cuts_toward_zero_and_drops_nan(spark):
    ident = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)))
    pts = spark.createDataFrame([(1, -0.3, 0.0, 1.0), (2, 0.0, 0.0, float("nan")), (3, -1.3, 0.0, 1.0)], "v int, x double, y double, z double")
    u, _, _ = G.project(ident, F.col("x"), F.col("y"), F.col("z"), F.lit(2.0), F.lit(2.0), F.lit(0.0), F.lit(0.0))
    got = {r.v: r.u for r in pts.select("v", u.alias("u")).collect()}
    assert got == {1: 0, 2: None, 3: -2}


def test_inverses(i):
    p = i.pose.withColumn("p", lift.camera_pose())
    same = F.forall(F.arrays_zip(F.col("p").alias("a"), G.rigid_inverse(G.rigid_inverse(F.col("p"))).alias("b")), lambda z: F.abs(z["a"] - z["b"]) < 1e-9)
    affine = F.forall(F.arrays_zip(G.affine_inverse(F.col("p")).alias("a"), G.rigid_inverse(F.col("p")).alias("b")), lambda z: F.abs(z["a"] - z["b"]) < 1e-9)
    assert p.where(~same | ~affine).count() == 0
    eye = G.rotvec_to_matrix(F.lit(0.0), F.lit(0.0), F.lit(0.0))
    assert p.limit(1).select(F.array(*eye).alias("m")).first().m == [1, 0, 0, 0, 1, 0, 0, 0, 1]


def test_flip_twice(i):
    twice = frames.flip_pixels(frames.flip_pixels(i.gt, 16), 16)
    assert twice.exceptAll(i.gt).count() == 0


def test_block_prune_loses_no_point(i):
    cam = {"fx": 8.0, "fy": 8.0, "cx": 8.0, "cy": 6.0, "width": 16, "height": 12}
    poses = i.pose.withColumn("pose", lift.camera_pose())
    plain, pruned = lift.points_x_frames(i.point, poses, cam), lift.points_x_frames(i.point, poses, cam, 0.3)
    assert plain.count() == pruned.count() and plain.exceptAll(pruned).count() == 0


def test_depth_fallbacks(spark):
    rows = [(0, 0, 0, 0, 100, 0), (0, 1, 0, 0, 100, 200), (0, 1, 1, 0, 100, 200), (0, 1, 2, 0, 100, 0), (0, 2, 0, 0, 10, 30), (0, 2, 1, 0, 20, 60), (0, 2, 2, 0, 30, 0)]
    d = spark.createDataFrame(rows, "scene_id int, frame_id int, px int, py int, mono int, depth_mm int")
    got = {(r.frame_id, r.px): r.completed for r in depth.complete_depth(d, 4).collect()}
    # nothing measured: the prediction; constant source: the solution of least norm; slope 3: the prediction
    assert got[0, 0] == 100 and got[1, 2] == int(100 * 100 * 200 / 10001 + 200 / 10001) and got[2, 2] == 30


def test_zbuffer_is_a_fold_and_not_the_nearest(spark):
    hits = spark.createDataFrame([(0, 0, 1.0), (0, 1, 0.97), (0, 2, 0.94), (1, 0, 1.0), (1, 1, 0.96)], "p int, inst_idx int, t double")
    got = {r.p: r.inst_idx for r in instances.zbuffer_fold(hits, ["p"], 0.05).collect()}
    assert got == {0: 2, 1: 0}


def test_paint_first_and_last(spark):
    inst = spark.createDataFrame([(0, 1, 7, 0.9, 3), (0, 2, 7, 0.4, 5)], "scene_id int, inst_id int, vertex_id int, score double, class_idx int")
    assert instances.paint_first_wins(inst).first().class_idx == 3
    assert instances.paint_last_wins(inst, instances.rank_instances(inst)).first().class_idx == 5


def test_nms_survivors(i):
    own = boxes.absolute_boxes(i.box, 640, 480)
    kept = boxes.nms_boxes(own, 0.3)
    assert boxes.box_pairs(kept, 0.3).count() == 0
    gone = own.join(kept, ["frame_id", "box_id"], "left_anti")
    over = boxes.box_pairs(own, 0.3).join(kept.select("frame_id", F.col("box_id").alias("a")), ["frame_id", "a"])
    assert gone.join(over.select("frame_id", F.col("b").alias("box_id")), ["frame_id", "box_id"], "left_anti").count() == 0 < gone.count()


def test_components_touch_by_corners(spark):
    m = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 3, 0), (2, 5, 5)], "m int, px int, py int")
    assert {r.m: r.n_components for r in masks.mask_components(m, ["m"]).collect()} == {1: 2, 2: 1}
    assert {r.m for r in masks.fragment_filter(m, ["m"], 2).collect()} == {2}


def test_nearest_ties_and_few_targets(spark):
    ref = spark.createDataFrame([(0, 10), (1, 10)], "scene_id int, us long")
    target = spark.createDataFrame([(0, 8), (0, 12)], "scene_id int, us long")
    early, late = sync.nearest_timestamp(ref, target), sync.nearest_timestamp(ref, target, True)
    assert {r.scene_id: (r.match, r.dt, r.margin) for r in early.collect()} == {0: (8, 2, 0), 1: (None, None, None)}
    assert late.where("scene_id = 0").first().match == 12


def test_interpolated_rotation(spark):
    t = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (0, 100, 0.0, 0.0, 1.0, 2.0, 0.0, 0.0)], "scene_id int, us long, rx double, ry double, rz double, tx double, ty double, tz double")
    got = sync.interpolate_pose(sync.bracket_pose(spark.createDataFrame([(0, 25)], "scene_id int, us long"), t)).first()
    assert got.tx == pytest.approx(0.5) and got.qz == pytest.approx(math.sin(0.125))


def test_plans(i):
    near = sync.nearest_timestamp(i.sensor.where("kind = 'click'").select("scene_id", "us"), i.sensor.where("kind = 'error'").select("scene_id", "us"))
    assert not any(x in near._jdf.queryExecution().executedPlan().toString() for x in ("Cartesian", "NestedLoop"))
    spark = i.spark
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        t = vote.vote_table(i.vocab, ["ade20k"], "wn_merged")
        counted = vote.vote(i.pred, t)._jdf.queryExecution().executedPlan().toString()
        assert counted.count("Exchange hashpartitioning(scene_id") == 1  # none between the aggregations
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_cached_confmat_counts_changed_scenes_only(spark, tmp_path):
    at, asked = f"file://{tmp_path}/c", []

    def rows(changed=None):
        found = [(s, f, x, x % 3) for s in (1, 2, 3) for f in (0, 1) for x in range(5)]
        return spark.createDataFrame([r if r[:3] != changed else (*r[:3], 7) for r in found], "scene_id int, frame_id int, px int, label int")

    def count(pred, truth):
        asked.append({r.scene_id for r in pred.select("scene_id").distinct().collect()})
        pairs = pred.withColumnRenamed("label", "pred_id").join(truth.withColumnRenamed("label", "label_id"), ["scene_id", "frame_id", "px"])
        return confusion.running_confmat(pairs)

    def run(pred, truth, key={"stride": 1}, **kw):
        got = files.cached_confmat(spark, at, key, [pred, truth], count, **kw)
        want = count(pred, truth)
        asked.pop()
        assert got.count() == want.count() and got.select(*want.columns).exceptAll(want).count() == 0

    run(rows(), rows())
    run(rows().repartition(5), rows())  # the order of rows is no change
    assert asked == [{1, 2, 3}]
    run(rows(), rows((2, 1, 3)))  # the truth of one pixel
    run(rows((3, 0, 0)), rows((2, 1, 3)))
    run(rows(), rows().where("scene_id < 3"))  # a scene's truth is gone
    run(rows(), rows())  # and back
    assert asked == [{1, 2, 3}, {2}, {3}, {3}, ]
    run(rows(), rows(), {"stride": 2})
    run(rows(), rows(), overwrite=True)
    assert asked[4:] == [{1, 2, 3}, {1, 2, 3}]
    # a run that stopped before its scenes were written doesn't count
    broken = tmp_path / "c" / "stride=1" / "run-x" / "counts"
    broken.mkdir(parents=True)
    (broken / "part.parquet").write_bytes(b"half")
    run(rows(), rows())


def test_dense_numbers_of_one_long_tail(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("name"), F.lit(4).alias("total"))
        placed = vocab.numbered_by(rows, [F.desc("total"), "name"])
        assert placed.agg(F.min("place"), F.max("place"), F.count_distinct("place")).first() == (0, 999_999, 1_000_000)
        assert placed.where("place > 0").sample(0.001, 1).limit(50).count() > 0
        by = placed.select("name", "place").orderBy("place").limit(1000).collect()
        assert [r.name for r in by] == sorted(r.name for r in by) and by[0].place == 0
        # every range has its share of the rows, though all have one total
        held = placed.groupBy(F.floor(F.col("place") / 250_000)).count().collect()
        assert len(held) == 4 and "Window [row_number" not in placed._jdf.queryExecution().executedPlan().toString()
        assert vocab.numbered_by(rows.limit(0), ["name"]).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_batches_count_once(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    batch = lambda n: spark.createDataFrame([(0, n, 1), (0, n, 1), (0, 5, n)], "scene_id int, pred_id int, label_id int")
    add = confusion.counts_sink(at)
    read = lambda: {(r.pred_id, r.label_id): r.n for r in confusion.merged_counts(spark, at).collect()}
    for n in (0, 1, 1, 0, 2):
        add(batch(n), n)
    want = {(0, 1): 2, (1, 1): 2, (2, 1): 2, (5, 0): 1, (5, 1): 1, (5, 2): 1}
    assert read() == want
    (tmp_path / "s" / "batch-9").mkdir()  # begun, not finished
    assert read() == want
    confusion.compact_counts(spark, at)
    assert read() == want and (tmp_path / "s" / "base-2").exists()
    add(batch(2), 2)  # comes again after it was merged
    assert read() == want
    add(batch(3), 3)
    confusion.compact_counts(spark, at)
    assert read() == want | {(3, 1): 2, (5, 3): 1}


def test_windowed_counts_close(spark, tmp_path):
    rows = [("2024-01-01 00:01:00", 1, 1), ("2024-01-01 00:04:59", 1, 1), ("2024-01-01 00:05:00", 1, 2), ("2024-01-01 01:00:00", 2, 2), ("2024-01-01 01:01:00", 2, 2), ("2024-01-01 00:02:00", 1, 1), ("2024-01-01 02:00:00", 3, 3)]
    for k, r in enumerate(rows):
        spark.createDataFrame([r], "ts string, pred_id int, label_id int").select(F.col("ts").cast("timestamp").alias("ts"), "pred_id", "label_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"k={k}"))
    stream = spark.readStream.schema("ts timestamp, pred_id int, label_id int, k int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = confusion.windowed_confmat(stream).writeStream.outputMode("append").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(str(r.start)[11:16], r.pred_id, r.label_id): r.n for r in spark.table("windows").collect()}
    # the row of 00:02 came two batches after an hour's jump and is too late; the last window is still open
    assert got == {("00:00", 1, 1): 2, ("00:05", 1, 2): 1, ("01:00", 2, 2): 2}


def test_workspace_is_listed_where_asked(spark, tmp_path):
    for scene in ("s1", "s2"):
        for folder in ("color", "depth", "intermediate/wordnet_ovseg_1", "intermediate/ade20k_cmx_1"):
            at = tmp_path / scene / folder
            at.mkdir(parents=True)
            for name in ("000000.png", "000012.png", "notes.txt"):
                (at / name).write_text(scene)
    root = f"file://{tmp_path}"
    every = files.list_workspace(spark, root, modalities=["color", "depth"]).collect()
    assert sorted((r.scene, r.modality, r.frame_id, r.length) for r in every) == sorted((s, m, f, 2) for s in ("s1", "s2") for m in ("color", "depth") for f in (0, 12))
    some = files.list_workspace(spark, root, ["s2"], ["intermediate/*"])
    assert {(r.scene, r.modality) for r in some.collect()} == {("s2", "wordnet_ovseg_1"), ("s2", "ade20k_cmx_1")} and all("/s2/intermediate/" in f for f in some.inputFiles())
    folders = some.select(F.col("modality").alias("folder")).distinct()
    assert {r.label_space for r in frames.predictor_catalog(folders).collect()} == {"wordnet", "ade20k"}
    # no file's content is read, and folders named by columns are pruned by filters
    assert "content" not in str(some._jdf.queryExecution().executedPlan()).split("ReadSchema")[1]
    spark.range(12).select((F.col("id") % 3).alias("scene"), F.lit("color").alias("modality"), F.lit("x").alias("value")).write.partitionBy("scene", "modality").text(f"{root}/named")
    named = files.list_partitioned(spark, f"{root}/named").where("scene = 1")
    assert "PartitionFilters: [isnotnull(scene" in named._jdf.queryExecution().executedPlan().toString() and {r.scene for r in named.collect()} == {1}


def test_workspace_is_listed_by_tasks(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/w"
    rows = spark.createDataFrame([(s, m, f, f"{m} {f}") for s in (1, 2, None) for m in ("color", "a/b c=é") for f in (0, 12)] + [(3, "color", 5, None)], "scene int, modality string, frame_id int, value string")
    files.write_workspace(rows, root, "scene", "modality", "frame_id")
    (tmp_path / "w" / "scene=1" / "_SUCCESS").write_text("")
    columns = "scene int, modality string, frame_id int"
    every = files.list_by_tasks(spark, root, columns)
    want = {(r.scene, r.modality, r.frame_id, len((r.value or "").encode()) + 1) for r in rows.collect()}
    assert sorted(map(str, ((r.scene, r.modality, r.frame_id, r.length) for r in every.collect()))) == sorted(map(str, want))
    plain = ["path", "scene", "modality", "frame_id", "length"]
    assert {r.path for r in every.where("modality = 'color'").collect()} == {r.path for r in files.list_partitioned(spark, root).where("modality = 'color'").collect()}
    some = files.list_by_tasks(spark, root, columns, {"scene": [1], "modality": ["color"]})
    assert sorted(r.frame_id for r in some.collect()) == [0, 12] and every.count() == len(want)
    # the driver knows no file
    assert some.inputFiles() == [] and every.inputFiles() == []
    # stores that only Spark opens
    monkeypatch.setattr(files, "opened_by_tasks", lambda root: False)
    files.write_workspace(rows.where("scene = 1"), f"{root}2", "scene", "modality", "frame_id")
    again = files.list_by_tasks(spark, f"{root}2", columns, {"modality": ["color"]})
    assert again.schema == every.schema and sorted((r.scene, r.frame_id, r.length) for r in again.select(*plain).collect()) == [(1, 0, 8), (1, 12, 9)]


def test_workspace_query_lists_nothing_on_the_driver(spark):
    assert catalog.QUERIES["s01_list_workspace"](spark, "/root/testdata/sf0.001").inputFiles() == []


def test_scan_files(spark, tmp_path):
    (tmp_path / "pose").mkdir()
    (tmp_path / "pose" / "000007.txt").write_text("1 0 0\n0 1 0\n0 0 1\n")
    assert [(r.frame_id, r.matrix) for r in files.read_matrix_text(spark, str(tmp_path / "pose")).collect()] == [(7, [1, 0, 0, 0, 1, 0, 0, 0, 1])]
    (tmp_path / "traj.txt").write_text("1 2 3\n4 5 6\n")
    assert [(r.line, r.pose) for r in files.read_pose_lines(spark, str(tmp_path / "traj.txt")).collect()] == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    (tmp_path / "a.pincam").write_text("640 480 500 501 320 240\n")
    assert files.read_pinhole_intrinsics(spark, str(tmp_path / "a.pincam")).first().cy == 240
    (tmp_path / "frame_00012.json").write_text('{"cameraPoseARFrame": [1.0, 2.0], "intrinsics": [3.0]}')
    assert files.read_frame_json(spark, str(tmp_path / "frame_00012.json")).first().frame_id == 12


def test_stream_counts_are_the_batchs(spark, i, tmp_path):
    pairs = i.pred.where("model_no = 2").select(*PIXEL, F.col("label").alias("pred_id")).join(i.gt.select(*PIXEL, F.col("label").alias("label_id")), PIXEL).select("scene_id", "pred_id", "label_id")
    pairs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = confusion.running_confmat(stream).writeStream.outputMode("complete").format("memory").queryName("confmat").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("confmat").exceptAll(confusion.running_confmat(pairs)).count() == 0 < spark.table("confmat").count()
