"""Registered queries of the fusion operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.functions import geometry as G
from fusemill.operators import boxes, depth, evaluate, frames, fusion, instances, lift, masks, spline, sync, vocab, vote
from fusemill.plans.fixtures import Inputs, duck
from fusemill.sources import files
from fusemill.streaming import confusion

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIXEL = ["scene_id", "frame_id", "px", "py"]
WIDTH, HEIGHT = 16, 12
CAMERA = {"fx": 8.0, "fy": 8.0, "cx": 8.0, "cy": 6.0, "width": WIDTH, "height": HEIGHT}
SPACES = ["ade20k", "nyu40id", "wn199", "id"]
DT_MAX = 300_000_000


def query(sql: str | None = None):
    """Registers a function of Inputs under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = duck(sql)
        return fn

    return add


def r6(*cols: str):
    return [(F.round(F.col(c), 6) + F.lit(0.0)).alias(c) for c in cols]


def _ids(space: str, alias: str = "fx_vocab") -> str:
    """DuckDB: row_idx and each id of a cell."""
    return f"(select row_idx, cast(trim(unnest(string_split(cast({space} as varchar), ','))) as int) id, category, color, cnt from {alias} where {space} is not null)"


def _pairs(left: str, right: str) -> str:
    return f"(select distinct a.id l, b.id r from {_ids(left)} a join {_ids(right)} b using (row_idx))"


# --- scans --------------------------------------------------------------------------------------------------------


def _paths(i: Inputs) -> DataFrame:
    one = i.pixel.select("scene_id", "frame_id").distinct()
    return one.select(F.explode(F.array(*(F.format_string(f"s%d/{m}/%06d.png", "scene_id", "frame_id") for m in ("color", "depth"))), ).alias("path"))


_PATHS = "(select 's' || scene_id || '/' || m || '/' || lpad(cast(frame_id as varchar), 6, '0') || '.png' path, m modality, frame_id from (select distinct scene_id, frame_id from fx_pixel) cross join (values ('color'),('depth')) v(m))"


@query(f"select path, modality, frame_id from {_PATHS}")
def s01_frame_manifest(i):
    return frames.frame_manifest(_paths(i))


@query("""select distinct folder, split_part(folder,'_',1) label_space, split_part(folder,'_',2) model, split_part(folder,'_',3) as version, suffix(folder,'_flip') flip
  from (select case label_space when 'nyu40id' then 'nyu40' when 'wn199' then 'wn' when 'id' then 'scannet200' else label_space end || '_' || model || '_' || (1 + scene_id) || case when flip then '_flip' else '' end folder from fx_pred)
  where split_part(folder,'_',1) in ('ade20k','nyu40','scannet200','wordnet','scannet')""")
def s02_predictor_catalog(i):
    token = F.when(F.col("label_space") == "nyu40id", "nyu40").when(F.col("label_space") == "wn199", "wn").when(F.col("label_space") == "id", "scannet200").otherwise(F.col("label_space"))
    folder = F.concat_ws("_", token, "model", (F.col("scene_id") + 1).cast("string"), F.when(F.col("flip"), "flip"))
    return frames.predictor_catalog(i.pred.select(folder.alias("folder")).distinct())


def _poses(i: Inputs) -> DataFrame:
    return i.pose.withColumn("pose", lift.camera_pose())


_POSE = "list_value(c,-s,0,tx, s,c,0,ty, 0,0,1,tz, 0,0,0,1)"


@query(f"select frame_id, k - 1 pos, round(m[k], 6) v from (select frame_id, {_POSE} m from fx_pose) cross join range(1,17) t(k)")
def s03_read_matrix_text(i):
    path = files.scratch(i.spark, "matrix")
    text = F.array_join(F.transform("pose", lambda x, k: F.concat(F.when((k > 0) & (k % 4 == 0), "\n").otherwise(""), x.cast("string"))), " ")
    files.by_folder(_poses(i).select("frame_id", text.alias("value")), "frame_id").text(path)
    rows = files.read_matrix_text(i.spark, path, r"frame_id=(\d+)/")
    return rows.select("frame_id", F.posexplode("matrix").alias("pos", "v")).select("frame_id", "pos", *r6("v"))


@query("select scene_id, us, rx, ry, rz, tx, ty, tz from fx_traj")
def s05_read_trajectory(i):
    path = files.scratch(i.spark, "traj")
    cols = "us rx ry rz tx ty tz".split()
    i.traj.select("scene_id", *cols).write.partitionBy("scene_id").csv(path, sep=" ")
    return files.read_trajectory(i.spark, path).select("scene_id", F.col("us").cast("long").alias("us"), *cols[1:])


@query("select frame_id, cast(w as double) w, cast(h as double) h, 8.0::double fx, 8.0::double fy, cx, cy from (select frame_id, 640+frame_id%3 w, 480 h, (640+frame_id%3)/2.0e0 cx, 240.0e0 cy from fx_pose)")
def s06_read_pinhole_intrinsics(i):
    path = files.scratch(i.spark, "pincam")
    w = 640 + F.col("frame_id") % 3
    rows = i.pose.select("frame_id", w.alias("w"), F.lit(480), F.lit(8.0), F.lit(8.0), (w / 2).alias("a"), F.lit(240.0))
    files.by_folder(rows, "frame_id").csv(path, sep=" ")
    return files.read_pinhole_intrinsics(i.spark, path).select("frame_id", "w", "h", "fx", "fy", "cx", "cy")


@query(f"select frame_id, 'pose' part, k - 1 pos, round(m[k], 6)+0.0 v from (select frame_id, {_POSE} m from fx_pose) cross join range(1,17) t(k) union all select frame_id, 'intrinsics', k - 1, ([8e0,0,8,0,8,6,0,0,1])[k] from fx_pose cross join range(1,10) t(k)")
def s07_read_frame_json(i):
    path = files.scratch(i.spark, "json")
    k = F.array(*(F.lit(float(v)) for v in (8, 0, 8, 0, 8, 6, 0, 0, 1)))
    rows = _poses(i).select("frame_id", F.col("pose").alias("cameraPoseARFrame"), k.alias("intrinsics"))
    files.by_folder(rows, "frame_id").json(path)
    rows = files.read_frame_json(i.spark, path, r"frame_id=(\d+)/")
    long = lambda c: rows.select("frame_id", F.lit(c).alias("part"), F.posexplode(c).alias("pos", "v"))
    return long("pose").unionByName(long("intrinsics")).select("frame_id", "part", "pos", *r6("v"))


_VOCAB = "row_idx int, id int, category string, cnt int, wnsynsetkey string, wn199 string, wn_merged string, nyu40id string, ade20k string, color string"


@query("select row_idx, id, category, cnt, wnsynsetkey, wn199, ade20k, cast(split_part(color,'-',2) as int) green from fx_vocab")
def s08_read_vocabulary(i):
    path = files.scratch(i.spark, "vocab")
    i.vocab.select(*(x.split()[0] for x in _VOCAB.split(", "))).write.csv(path, header=True)
    rows = files.read_vocabulary(i.spark, path, _VOCAB)
    return rows.select("row_idx", "id", "category", "cnt", "wnsynsetkey", "wn199", "ade20k", vocab.color_of(F.col("color"))[1].alias("green"))


@query("select distinct 'masks/' || case when inst_id < 1000 then lpad(cast(inst_id as varchar), 3, '0') else cast(inst_id as varchar) end mask_path, class_idx class_id, score from fx_inst")
def s09_instance_predictions(i):
    path = files.scratch(i.spark, "inst")
    files.write_instance_predictions(i.inst, path)
    return files.read_instance_predictions(i.spark, f"{path}/predictions")


@query("select scene_id, frame_id, px, py, label from fx_gt")
def s10_read_label_pixels(i):
    path = files.scratch(i.spark, "labels")
    files.write_label_frames(frames.to_frame_arrays(i.gt, WIDTH), path)
    return frames.from_frame_arrays(i.spark.read.parquet(path), WIDTH).select(*PIXEL, "label")


@query("select scene_id, frame_id, count(*) n, sum(label * (py*16+px+1))::bigint checksum from fx_gt group by all")
def s11_write_label_frames(i):
    path = files.scratch(i.spark, "frames")
    files.write_label_frames(frames.to_frame_arrays(i.gt, WIDTH), path)
    read = i.spark.read.parquet(path).select("scene_id", "frame_id", F.posexplode("labels").alias("at", "label"))
    return read.groupBy("scene_id", "frame_id").agg(F.count("*").alias("n"), F.sum(F.col("label") * (F.col("at") + 1)).cast("long").alias("checksum"))


@query("select scene_id, us, lpad(cast(row_number() over (partition by scene_id order by us) - 1 as varchar), 6, '0') as name from (select distinct scene_id, us from fx_sensor where kind='click')")
def s12_write_manifest_json(i):
    path = files.scratch(i.spark, "manifest")
    ranked = frames.rank_frames(_sensor(i, "click"), "us").select("scene_id", "us", "name")
    files.write_manifest_json(ranked, path)
    return i.spark.read.schema("scene_id int, us long, name string").json(path)


_FOLDERS = {"rgb": "rgb", "label": "label", "mono_depth": "mono_depth", "sensor_depth": "depth"}
_META_CLASSES = f"(select scene_id, label, coalesce(n,0)/sum(coalesce(n,0)) over (partition by scene_id) as share from (select distinct scene_id from fx_gt) cross join (select distinct id as label from {_ids('wn_merged')} union select 0) left join (select scene_id,label,count(*) n from fx_gt group by all) using (scene_id,label))"


@query(f"""select scene_id, 'frame' part, frame_id as key, round(tx,6) v, 'rgb/' || lpad(frame_id::varchar,6,'0') || '.jpg depth/' || lpad(frame_id::varchar,6,'0') || '.png 8.0' as what from fx_pose
  union all select scene_id, 'class', label, round(share,6), coalesce(c.name,'unknown') || ' ' || coalesce(c.color,'0-0-0') from {_META_CLASSES} left join (select id as label, arg_min(category,row_idx) as name, arg_min(color,row_idx) color from {_ids('wn_merged')} group by id) c using (label)
  union all select scene_id, 'scene', 16*100+12, round(1/scale,6), round(center_x,4)::varchar from (select scene_id, (min(tx)+max(tx))/2 center_x, 2e0/(greatest(max(tx)-min(tx),max(ty)-min(ty),max(tz)-min(tz))+3e0) scale from fx_pose group by 1)""")
def s13_training_meta(i):
    classes = vocab.class_list(i.vocab, "wn_merged").withColumn("color", vocab.color_of(F.col("color")))
    shares = evaluate.class_histogram(i.gt, ["scene_id"], classes.select(F.col("id").alias("label")))
    meta = files.training_meta(_poses(i), fusion.pose_bounds(i.pose), classes, shares, CAMERA, _FOLDERS)
    part = lambda name, shape: meta.where(F.col("part") == name).select("scene_id", "part", "key", F.from_json("meta", shape).alias("m"))
    f = part("frame", "frame_id int, camtoworld array<double>, intrinsics array<double>, rgb_path string, sensor_depth_path string").select(
        "scene_id", "part", F.col("m.frame_id").alias("key"), F.col("m.camtoworld")[3].alias("v"), F.concat_ws(" ", "m.rgb_path", "m.sensor_depth_path", F.col("m.intrinsics")[4].cast("string")).alias("what")
    )
    c = part("class", "id int, name string, color array<int>, share double").select(
        "scene_id", "part", F.col("m.id").alias("key"), F.col("m.share").alias("v"), F.concat_ws(" ", "m.name", F.array_join(F.transform("m.color", lambda x: x.cast("string")), "-")).alias("what")
    )
    s = part("scene", "width int, height int, scale double, worldtogt array<double>").select(
        "scene_id", "part", (F.col("m.width") * 100 + F.col("m.height")).alias("key"), F.col("m.worldtogt")[5].alias("v"), F.round(F.col("m.worldtogt")[3], 4).cast("string").alias("what")
    )
    return f.unionByName(c).unionByName(s).select("scene_id", "part", "key", *r6("v"), "what")


def _counts(i: Inputs, space: str, to: str = "wn_merged", by: list[str] = [], pred: DataFrame | None = None) -> DataFrame:
    own = i.pred.where(F.col("label_space") == space) if pred is None else pred
    return evaluate.unmatched_confmat(own.select(*PIXEL, "label"), i.gt, PIXEL, vocab.space_ids(i.vocab, space), vocab.space_ids(i.vocab, to), by)


def _unmatched(space: str, to: str = "wn_merged", keys: str = "") -> str:
    return f"""(select {keys} pi.id pred_id, li.id label_id, count(*) n from (select * from fx_pred where label_space='{space}') p join fx_gt g using (scene_id,frame_id,px,py)
      left join (select distinct id from {_ids(space)}) pi on pi.id = p.label left join (select distinct id from {_ids(to)}) li on li.id = g.label group by all)"""


@query(f"select scene_id, p.label pred_id, g.label label_id, count(*) n from fx_pred p join (select scene_id, frame_id, px, py, case when scene_id=1 and frame_id%8=1 then label+1 else label end as label from fx_gt) g using (scene_id,frame_id,px,py) where model_no=2 group by all")
def s15_cached_confmat(i):
    path = files.scratch(i.spark, "confmat")
    key = {"source": "cmx", "space": "nyu40id", "stride": 1}
    pred = i.pred.where("model_no = 2").select(*PIXEL, "label")
    changed = i.gt.select(*PIXEL, F.when(F.expr("scene_id = 1 and frame_id % 8 = 1"), F.col("label") + 1).otherwise(F.col("label")).alias("label"))

    def count(p, t):
        pairs = p.withColumnRenamed("label", "pred_id").join(t.withColumnRenamed("label", "label_id"), PIXEL)
        return confusion.running_confmat(pairs)

    files.cached_confmat(i.spark, path, key, [pred, i.gt.select(*PIXEL, "label")], count)
    # only the scene with changed frames is counted again
    return files.cached_confmat(i.spark, path, key, [pred, changed], count).select("scene_id", "pred_id", "label_id", "n")


@query("select scene_id, p.label pred_id, g.label label_id, count(*) n from fx_pred p join fx_gt g using (scene_id,frame_id,px,py) where model_no=2 group by all")
def st01_stream_confmat(i):
    at = files.scratch(i.spark, "stream")
    pred = i.pred.where("model_no = 2").select(*PIXEL, F.col("label").alias("pred_id"))
    pairs = pred.join(i.gt.select(*PIXEL, F.col("label").alias("label_id")), PIXEL).select("scene_id", "pred_id", "label_id")
    pairs.repartition(4).write.parquet(f"{at}/in")
    add, seen = confusion.counts_sink(f"{at}/counts"), []

    def twice(batch, batch_id):
        # as after a restart: a batch comes again, even once it is merged
        add(batch, batch_id)
        if batch_id == 1:
            confusion.compact_counts(i.spark, f"{at}/counts")
        add(batch, batch_id)
        seen.append(batch_id)

    stream = i.spark.readStream.schema(pairs.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    stream.writeStream.foreachBatch(twice).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return confusion.merged_counts(i.spark, f"{at}/counts")


@query("select cast(scene_id as int) scene, modality, frame_id, length(text)+1 as length from (select scene_id, frame_id, m modality, m || ' ' || frame_id as text from (select distinct scene_id, frame_id from fx_pixel) cross join (values ('color'),('depth')) v(m)) where scene_id in (1,2) and modality='depth'")
def s01_list_workspace(i):
    at = files.scratch(i.spark, "workspace")
    frames_ = i.pixel.select("scene_id", "frame_id").distinct()
    rows = frames_.select(F.col("scene_id").alias("scene"), F.explode(F.array(F.lit("color"), F.lit("depth"))).alias("modality"), "frame_id")
    rows = rows.withColumn("value", F.concat_ws(" ", "modality", F.col("frame_id").cast("string")))
    files.write_workspace(rows, at, "scene", "modality", "frame_id")
    listed = files.list_by_tasks(i.spark, at, "scene int, modality string, frame_id int", {"scene": [1, 2], "modality": ["depth"]})
    return listed.select("scene", "modality", "frame_id", "length")


# --- vocabulary ---------------------------------------------------------------------------------------------------


@query(" union all ".join(f"select '{s}' space, id from (select distinct id from {_ids(s)})" for s in SPACES))
def v01_space_ids(i):
    parts = [vocab.space_ids(i.vocab, s).select(F.lit(s).alias("space"), "id") for s in SPACES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query(f"select l, r from {_pairs('ade20k', 'wn_merged')}")
def v02_space_pairs(i):
    return vocab.space_pairs(i.vocab, "ade20k", "wn_merged")


@query(f"select count(distinct a.id) n_left, (select count(distinct id) from {_ids('wn_merged')}) n_right, count(distinct a.id) >= (select count(distinct id) from {_ids('wn_merged')}) left_to_right from {_ids('nyu40id')} a")
def v03_map_direction(i):
    return vocab.map_direction(i.vocab, "nyu40id", "wn_merged")


@query(f"select p.*, case when t.n is null then -1 when t.n>1 then -2 else t.r end target from (select scene_id,frame_id,px,py,label from fx_pred where model_no=2) p left join (select l, count(*) n, min(r) r from {_pairs('nyu40id', 'wn_merged')} group by l) t on t.l = p.label")
def v04_translate_label(i):
    rows = i.pred.where("model_no = 2").select(*PIXEL, "label")
    return vocab.translate_label(rows, "label", i.vocab, "nyu40id", "wn_merged").select(*PIXEL, "label", "target")


@query(f"select l from_id, unnest(list_sort(list(r))) target from {_pairs('ade20k', 'wn_merged')} group by l having count(*) > 1")
def v05_ambiguous_targets(i):
    return vocab.ambiguous_targets(i.vocab, "ade20k", "wn_merged").select("from_id", F.explode("targets").alias("target"))


def _match_sql(l: str, r: str, left: str, right: str, lr: bool) -> str:
    src, oth, a, b, other = (l, r, "l", "r", right) if lr else (r, l, "r", "l", left)
    pairs = _pairs(left, right)
    return f"""case when {src} not in (select {a} from {pairs}) or {oth} not in (select id from {_ids(other)}) then -1
      when exists (select 1 from {pairs} q where q.{a} = {src} and q.{b} = {oth}) then 1 else 0 end"""


_TWO = "(select distinct a.label l, g.label r from fx_pred a join fx_gt g using (scene_id,frame_id,px,py) where a.model_no={m})"


def _label_pairs(i: Inputs, model: int) -> DataFrame:
    return i.pred.where(f"model_no = {model}").select(*PIXEL, F.col("label").alias("l")).join(i.gt.select(*PIXEL, F.col("label").alias("r")), PIXEL).select("l", "r").distinct()


@query(f"with two as {_TWO.format(m=0)} select l, r, {_match_sql('two.l', 'two.r', 'ade20k', 'wn_merged', True)} lr, {_match_sql('two.l', 'two.r', 'ade20k', 'wn_merged', False)} rl from two")
def v06_match_labels(i):
    rows = _label_pairs(i, 0)
    for name, lr in (("lr", True), ("rl", False)):
        rows = vocab.match_labels(rows, "l", "r", i.vocab, "ade20k", "wn_merged", lr).withColumnRenamed("match", name)
    return rows.select("l", "r", "lr", "rl")


_SYN = "(select distinct a.label s, case when b.label%7=0 then -1 else b.label end w from fx_pred a join fx_pred b using (scene_id,frame_id,px,py) where a.model_no=5 and b.model_no=3)"


@query(f"select s, w, case when v.wn199 is null or w=-1 then -1 when cast(v.wn199 as int)=w then 1 else 0 end as match from {_SYN} q left join fx_vocab v on v.id=q.s")
def v07_match_scannet_wordnet(i):
    a = i.pred.where("model_no = 5").select(*PIXEL, F.col("label").alias("s"))
    b = i.pred.where("model_no = 3").select(*PIXEL, F.when(F.col("label") % 7 == 0, -1).otherwise(F.col("label")).alias("w"))
    return vocab.match_by_synset(a.join(b, PIXEL).select("s", "w").distinct(), "s", "w", i.vocab).select("s", "w", "match")


_MODELS = "(select distinct a.label sid, b.label ade, c.label nyu from fx_pred a join fx_pred b using (scene_id,frame_id,px,py) join fx_pred c using (scene_id,frame_id,px,py) where a.model_no=5 and b.model_no=0 and c.model_no=2)"


@query(f"with three as {_MODELS} select sid, ade, nyu, {_match_sql('sid', 'ade', 'id', 'ade20k', True)} scannet_ade, {_match_sql('sid', 'nyu', 'id', 'nyu40id', True)} scannet_nyu, {_match_sql('ade', 'nyu', 'ade20k', 'nyu40id', True)} ade_nyu from three")
def v08_pairwise_matches(i):
    label = lambda m, n: i.pred.where(f"model_no = {m}").select(*PIXEL, F.col("label").alias(n))
    rows = label(5, "sid").join(label(0, "ade"), PIXEL).join(label(2, "nyu"), PIXEL).select("sid", "ade", "nyu").distinct()
    for name, l, r, left, right in (("scannet_ade", "sid", "ade", "id", "ade20k"), ("scannet_nyu", "sid", "nyu", "id", "nyu40id"), ("ade_nyu", "ade", "nyu", "ade20k", "nyu40id")):
        rows = vocab.match_labels(rows, l, r, i.vocab, left, right, True).withColumnRenamed("match", name)
    return rows.select("sid", "ade", "nyu", "scannet_ade", "scannet_nyu", "ade_nyu")


@query(f"select a.id from_id, arg_min(v.id, row_idx) target from {_ids('ade20k')} a join fx_vocab v using (row_idx) group by 1")
def v09_first_target(i):
    return vocab.first_target(i.vocab, "ade20k", "id")


@query(f"select 'wn' kind, a.id from_id, arg_max(cast(v.wn_merged as int), row_idx) target from {_ids('nyu40id')} a join fx_vocab v using (row_idx) where v.wn_merged is not null group by 2 union all select 'id', a.id, arg_max(v.id, row_idx) from {_ids('wn_merged')} a join fx_vocab v using (row_idx) group by 2")
def v10_last_target(i):
    a = vocab.last_target(i.vocab, "nyu40id", "wn_merged").withColumn("kind", F.lit("wn"))
    return a.unionByName(vocab.last_target(i.vocab, "wn_merged", "id").withColumn("kind", F.lit("id"))).select("kind", "from_id", "target")


@query("""select row_idx, string_agg(cast(q.id as varchar), ',' order by pos) filter (q.id is not null) ids, count(*) filter (q.id is null) unknown
  from (select row_idx, pos, c.id from (select row_idx, trim(unnest(string_split(names, ','))) as name, generate_subscripts(string_split(names, ','), 1) pos
    from (select row_idx, category || ', no such ,' || coalesce(lead(category) over (order by row_idx), category) as names from fx_vocab))
    left join (select category as name, min(id) id from fx_vocab group by 1) c using (name)) q group by 1""")
def v11_resolve_ids_from_names(i):
    from pyspark.sql import Window

    after = F.coalesce(F.lead("category").over(Window.orderBy("row_idx")), "category")
    rows = i.vocab.select("row_idx", F.concat("category", F.lit(", no such ,"), after).alias("names"))
    return vocab.resolve_ids_from_names(rows, "row_idx", "names", i.vocab.select(F.col("category").alias("name"), "id"))


@query("""select v.id, category as name, case when v.id%5=0 then 10 else case when v.id%5=1 then 20 else v.id*37%256 end end r,
   case when v.id%5=0 then 11 when v.id%5=1 then 21 else v.id*101%256 end g, case when v.id%5=0 then 12 when v.id%5=1 then 22 else v.id*197%256 end b from fx_vocab v""")
def v12_assign_colors(i):
    ids = i.vocab.select("id", F.concat_ws(" ", "category", "id").alias("name"), "category")
    fixed = lambda *v: F.array(*(F.lit(x) for x in v))
    out = vocab.assign_colors(ids, ids.where("id % 5 = 0").select("id", fixed(10, 11, 12).alias("color")), ids.where("id % 5 = 1").select("name", fixed(20, 21, 22).alias("color")))
    return out.select("id", F.col("category").alias("name"), *(F.col("color")[k].alias(c) for k, c in enumerate("rgb")))


@query("""select cast(row_number() over (order by total desc, name) as int) id, name, total, color from (select wnsynsetkey as name, sum(cnt)::bigint total, arg_min(color,row_idx) color from fx_vocab where wnsynsetkey is not null group by 1 having sum(cnt)>3)
  union all select 0, 'unknown', 0, '0-0-0'""")
def v13_classes_by_occurrence(i):
    return vocab.classes_by_occurrence(i.vocab)


@query(f"select id, arg_min(category,row_idx) as name, arg_min(color,row_idx) color from {_ids('wn_merged')} group by id union all select 0, 'unknown', '0-0-0' where 0 not in (select id from {_ids('wn_merged')})")
def v14_class_list(i):
    return vocab.class_list(i.vocab, "wn_merged")


@query(f"select 'ade20k' space, id, arg_min(category,row_idx) as name from {_ids('ade20k')} group by id union all select 'id', id, category from fx_vocab")
def v15_class_dimension(i):
    ade = vocab.class_list(i.vocab, "ade20k").where("name <> 'unknown'").select(F.lit("ade20k").alias("space"), "id", "name")
    return ade.unionByName(i.vocab.select(F.lit("id").alias("space"), "id", F.col("category").alias("name")))


@query("select idx, id from (select cast(row_number() over (order by id) - 1 as int) idx, id from (select distinct label id from fx_pred where model_no=5)) union all select cast(count(distinct label) as int), -1 from fx_pred where model_no=5")
def v16_compact_ids(i):
    return vocab.compact_ids(i.pred.where("model_no = 5").select(F.col("label").alias("id")), -1)


@query("select label, label+1 nyu, case when label+2=2 then 1 else label+2 end inst, count(*) n from fx_pred where model_no in (2,3) group by 1")
def v17_shift_ids(i):
    c = F.col("label")
    return i.pred.where("model_no in (2, 3)").groupBy("label").agg(F.count("*").alias("n")).select("label", vocab.shift_nyu(c).alias("nyu"), vocab.shift_instance(c).alias("inst"), "n")


@query("""select id, tno template_no, size, replace(replace(t, '{}', case when size<>'' then size || ' ' else '' end || replace(split_part(wnsynsetkey,'.',1),'_',' ')), '{definition}', 'a thing of size ' || cnt) || ' It can also be called ' || category || ', ' || color prompt
  from fx_vocab cross join (values (0,'a photo of a {}.'),(1,'there is a {} in the scene.'),(2,'a {}, that is {definition}.')) a(tno,t) cross join (values (''),('small'),('large')) b(size) where wnsynsetkey is not null""")
def v18_class_prompts(i):
    classes = i.vocab.where("wnsynsetkey is not null").select(
        "id", F.col("wnsynsetkey").alias("synset"), F.array("wnsynsetkey", "category", "color").alias("lemmas"), F.concat(F.lit("a thing of size "), F.col("cnt").cast("string")).alias("definition")
    )
    templates = i.spark.createDataFrame([(0, "a photo of a {}."), (1, "there is a {} in the scene."), (2, "a {}, that is {definition}.")], "template_no int, template string")
    return vocab.class_prompts(classes, templates, i.spark.createDataFrame([("",), ("small",), ("large",)], "size string"))


@query("select lower(string_agg(replace(split_part(wnsynsetkey,'.',1),'_',' '), ', ' order by id)) || '.' caption from fx_vocab where wnsynsetkey is not null")
def v19_class_nouns(i):
    return vocab.caption(i.vocab.where("wnsynsetkey is not null").select("id", F.col("wnsynsetkey").alias("synset")))


@query(f"select scene_id,frame_id,px,py,label, round(coalesce(cast(split_part(color,'-',1) as int),0)/255.0e0,6) r, round(coalesce(cast(split_part(color,'-',2) as int),0)/255.0e0,6) g, round(coalesce(cast(split_part(color,'-',3) as int),0)/255.0e0,6) b from fx_gt left join (select id, arg_min(color,row_idx) color from {_ids('wn_merged')} group by id) c on c.id=label")
def v20_colorize(i):
    classes = vocab.class_list(i.vocab, "wn_merged").where("id > 0")
    return vocab.colorize(i.gt, classes).select(*PIXEL, "label", *r6("r", "g", "b"))


# --- projections and filters --------------------------------------------------------------------------------------


@query("select scene_id, frame_id from (select *, row_number() over (partition by scene_id order by frame_id) n from (select distinct scene_id, frame_id from fx_pixel)) where (n-1)%3=0")
def p01_sample_frames(i):
    return frames.sample_frames(i.pixel.select("scene_id", "frame_id").distinct(), 3)


@query("select g.scene_id, g.frame_id, p.frame_id pred_frame, count(*) n from fx_gt g join (select * from fx_pred where model_no=2) p on p.scene_id=cast(floor(g.frame_id/2) as int)%4 and p.frame_id=cast(floor(g.frame_id/2) as int) and p.px=g.px and p.py=g.py where p.label>g.label group by all")
def p02_frame_subkey(i):
    truth = i.gt.select("scene_id", "frame_id", "px", "py", "label", frames.frame_subkey(F.col("frame_id"), 2).alias("pred_frame"))
    pred = i.pred.where("model_no = 2").select(F.col("frame_id").alias("pred_frame"), "px", "py", F.col("label").alias("p"))
    return truth.join(pred, ["pred_frame", "px", "py"]).where("p > label").groupBy("scene_id", "frame_id", "pred_frame").agg(F.count("*").alias("n"))


@query("select scene_id, frame_id, 15-px px, py, label from fx_pred where flip")
def p03_flip_pixels(i):
    return frames.flip_pixels(i.pred.where("flip").select(*PIXEL, "label"), WIDTH)


@query("select f.scene_id, f.frame_id, x::int px, y::int py, g.label from (select distinct scene_id, frame_id from fx_gt) f cross join range(0,24) a(x) cross join range(0,8) b(y) join fx_gt g on g.scene_id=f.scene_id and g.frame_id=f.frame_id and g.px=floor(x*16/24) and g.py=floor(y*12/8)")
def p04_resample_nearest(i):
    return frames.resample_nearest(i.gt, "label", (WIDTH, HEIGHT), (24, 8)).select(*PIXEL, "label")


@query("""select scene_id, frame_id, x::int px, y::int py, round(sum(wx*wy*depth_mm),6) depth_mm from (
   select x, y, greatest(0,least(15,floor(sx)+dx)) ax, greatest(0,least(11,floor(sy)+dy)) ay, case dx when 0 then 1-(sx-floor(sx)) else sx-floor(sx) end wx, case dy when 0 then 1-(sy-floor(sy)) else sy-floor(sy) end wy
   from (select x, y, (x+0.5e0)*(16/24e0)-0.5e0 sx, (y+0.5e0)*(12/8e0)-0.5e0 sy from range(0,24) a(x) cross join range(0,8) b(y)) cross join (values (0),(1)) c(dx) cross join (values (0),(1)) d(dy)) g
  join fx_depth on px=ax and py=ay group by all""")
def p05_resample_bilinear(i):
    return frames.resample_bilinear(i.depth, "depth_mm", (WIDTH, HEIGHT), (24, 8)).select(*PIXEL, *r6("depth_mm"))


@query("select frame_id, round((500+frame_id)*1.5e0,6) fx, round((501+frame_id)*0.5e0,6) fy, round(8*1.5e0,6) cx, round(6*0.5e0,6) cy from fx_pose")
def p06_scale_intrinsics(i):
    k = i.pose.select("frame_id", (F.col("frame_id") + 500.0).alias("fx"), (F.col("frame_id") + 501.0).alias("fy"), F.lit(8.0).alias("cx"), F.lit(6.0).alias("cy"))
    return frames.scale_intrinsics(k, 1.5, 0.5).select("frame_id", *r6("fx", "fy", "cx", "cy"))


@query("select frame_id, round((640+frame_id)/2e0/tan(radians(90)/2),6) fx, round((640+frame_id)/2e0/tan(radians(90)/2),6) fy, (639+frame_id)/2e0 cx, 239.5e0 cy from fx_pose")
def p07_fov_intrinsics(i):
    fx, fy, cx, cy = G.fov_intrinsics((F.col("frame_id") + 640).cast("double"), F.lit(480.0))
    return i.pose.select("frame_id", fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy")).select("frame_id", *r6("fx", "fy", "cx", "cy"))


@query("select scene_id,frame_id,px,py, case when k%3<2 then 0 else depth_mm end depth_mm from fx_depth")
def p08_mask_low_confidence(i):
    conf = i.pixel.select(*PIXEL, (F.col("k") % 3).cast("int").alias("conf"))
    return frames.mask_low_confidence(i.depth, conf).select(*PIXEL, "depth_mm")


@query("select scene_id,frame_id,px,py, round(depth_mm/1000e0,6) depth_m from fx_depth where depth_mm/1000e0<=3.0")
def p09_depth_units(i):
    return frames.depth_metres(i.depth).select(*PIXEL, *r6("depth_m"))


@query("select scene_id, frame_id from fx_pose where frame_id%5<>0")
def p10_valid_pose(i):
    bad = F.when(F.col("frame_id") % 5 == 0, F.lit(float("inf"))).otherwise(F.col("tx"))
    return _poses(i).withColumn("pose", F.concat("pose", F.array(bad))).where(G.finite(F.col("pose"))).select("scene_id", "frame_id")


@query("select scene_id,frame_id,px,py, case when label>100 then 0 else label end as label from fx_gt")
def p11_clip_unknown_labels(i):
    return frames.clip_unknown_labels(i.gt, 100).select(*PIXEL, "label")


@query("select scene_id,frame_id,max(label) largest from fx_gt group by all having max(label)>178")
def p12_label_range_check(i):
    return frames.label_range_violations(i.gt, 178)


@query("select scene_id,frame_id,px,py,class_idx,score from fx_score where score>0.25")
def p13_score_filter(i):
    return i.score.where("score > 0.25")


def _boxes(i: Inputs) -> DataFrame:
    return boxes.absolute_boxes(i.box, 640, 480)


_BOXES = "(select frame_id, box_id, score, (cx-w/2)*640 x0, (cx+w/2)*640 x1, (cy-h/2)*480 y0, (cy+h/2)*480 y1 from fx_box)"


@query(f"select frame_id, box_id, round(x0,6) x0, round(y0,6) y0, round(x1,6) x1, round(y1,6) y1 from {_BOXES}")
def p14_absolute_boxes(i):
    return _boxes(i).select("frame_id", "box_id", *r6("x0", "y0", "x1", "y1"))


@query("select variant, count(*) n from (select m.model variant, p.model from fx_pred p cross join (select distinct model from fx_model) m where p.model<>m.model) group by 1")
def p15_exclude_models(i):
    variants = i.pred.select(F.col("model").alias("variant"), F.col("model").alias("without")).distinct()
    return vote.exclude_models(i.pred, variants).groupBy("variant").agg(F.count("*").alias("n"))


# --- joins --------------------------------------------------------------------------------------------------------


@query("select d.scene_id,d.frame_id,d.px,d.py,depth_mm,label,concept from fx_depth d join fx_gt using (scene_id,frame_id,px,py) join fx_pixel using (scene_id,frame_id,px,py)")
def j01_join_modalities(i):
    return frames.join_modalities([i.depth.select(*PIXEL, "depth_mm"), i.gt.select(*PIXEL, "label"), i.pixel.select(*PIXEL, "concept")], PIXEL)


@query("select scene_id, frame_id, case when frame_id%5=0 then 'left' else 'right' end only_in from (select distinct scene_id, frame_id from fx_pixel) where (frame_id%5=0) <> (frame_id%7=0)")
def j02_check_key_sets(i):
    keys = ["scene_id", "frame_id"]
    return frames.check_key_sets(i.pixel.where("frame_id % 7 <> 0"), i.pixel.where("frame_id % 5 <> 0"), keys)


@query("""select scene_id, model, n n_frames from (select *, max(n) over (partition by scene_id) most from
  (select scene_id, model, count(distinct frame_id) n from fx_pred where not (model='ovseg' and frame_id%3=0) group by all)) where n<most""")
def j03_check_counts(i):
    return frames.check_counts(i.pred.where("not (model = 'ovseg' and frame_id % 3 = 0)"))


def _sensor(i: Inputs, kind: str) -> DataFrame:
    return sync.dedupe_timestamps(i.sensor.where(F.col("kind") == kind)).select("scene_id", "us")


def _nearest_sql(later: bool = False, target: str = "purchase") -> str:
    sign = "desc" if later else "asc"
    return f"""(select scene_id, us, list(t order by dt, t {sign}) ts from (select r.scene_id, r.us, t.us t, abs(r.us-t.us) dt from (select distinct scene_id,us from fx_sensor where kind='click') r
      join (select distinct scene_id,us from fx_sensor where kind='{target}') t using (scene_id)) group by 1,2)"""


@query(f"select scene_id, us, ts[1] as match, abs(us-ts[1]) dt, abs(us-ts[2])-abs(us-ts[1]) margin from {_nearest_sql()}")
def j04_nearest_timestamp(i):
    return sync.nearest_timestamp(_sensor(i, "click"), _sensor(i, "purchase"))


@query(f"""select q.*, cast(row_number() over (partition by scene_id order by us)-1 as int) frame_id, lpad(cast(row_number() over (partition by scene_id order by us)-1 as varchar),6,'0') as name
  from (select a.scene_id, a.us, a.ts[1] depth, b.ts[1] conf from {_nearest_sql()} a join {_nearest_sql(target='error')} b using (scene_id,us)
   join (select scene_id, min(us) lo, max(us) hi from fx_traj group by 1) t using (scene_id) where abs(a.us-a.ts[1])<{DT_MAX} and abs(a.us-b.ts[1])<{DT_MAX} and a.us between lo and hi) q""")
def j05_synchronize_streams(i):
    return sync.synchronize_streams(_sensor(i, "click"), {"depth": _sensor(i, "purchase"), "conf": _sensor(i, "error")}, i.traj, DT_MAX)


@query(f"select scene_id, us, abs(us-ts[1]) dt, coalesce(abs(us-ts[2])-abs(us-ts[1])<60000000, false) ambiguous, abs(us-ts[1])>0 inexact from {_nearest_sql()} where ambiguous or inexact")
def j06_ambiguous_sync_report(i):
    near = sync.nearest_timestamp(_sensor(i, "click"), _sensor(i, "purchase"))
    return sync.ambiguous_sync_report(near, 60_000_000).select("scene_id", "us", "dt", "ambiguous", "inexact")


_EVEN = "(select distinct scene_id, cast(floor(us/120000000) as bigint)*2 us from fx_sensor where kind='{k}')"


@query(f"select scene_id, us, list(t order by abs(us-t), t desc)[1] as match from (select r.scene_id, r.us+1 us, t.us t from {_EVEN.format(k='click')} r join {_EVEN.format(k='purchase')} t using (scene_id)) group by 1,2")
def j07_nearest_tie_later(i):
    coarse = lambda k, d: i.sensor.where(F.col("kind") == k).select("scene_id", (F.floor(F.col("us") / 120_000_000).cast("long") * 2 + d).alias("us")).distinct()
    return sync.nearest_timestamp(coarse("click", 1), coarse("purchase", 0), tie_later=True).select("scene_id", "us", "match")


@query("select scene_id, kind, cast(floor(us/60000000) as bigint) us, min(event_id) event_id from fx_sensor group by 1,2,3")
def j08_dedupe_timestamps(i):
    return sync.dedupe_timestamps(i.sensor.withColumn("us", F.floor(F.col("us") / 60_000_000).cast("long")))


_SEEN = """(select v.scene_id, frame_id, vertex_id, cast(trunc(u) as int) px, cast(trunc(w) as int) py, z from (
   select p.scene_id, f.frame_id, vertex_id, c*(x-tx)+s*(y-ty) a, -s*(x-tx)+c*(y-ty) b, z-tz z, (8*(c*(x-tx)+s*(y-ty))+8*(z-tz))/(z-tz+1e-6) u, (8*(-s*(x-tx)+c*(y-ty))+6*(z-tz))/(z-tz+1e-6) w
   from fx_point p join fx_pose f using (scene_id)) v where trunc(u)>=0 and trunc(u)<16 and trunc(w)>=0 and trunc(w)<12 and z>0)"""


def _seen(i: Inputs, block: float | None = 0.5) -> DataFrame:
    return lift.places_x_views(i.point, _poses(i), CAMERA, block)


@query(f"select scene_id, frame_id, count(*) n, sum(vertex_id*(px+16*py))::bigint checksum from {_SEEN} group by all")
def j09_points_x_frames(i):
    return lift.seen_by_frame(_seen(i), _poses(i), WIDTH)


_HOLED = "(select *, case when (px+py)%9=0 then 0e0 else 2e0 end depth_m from fx_gt)"


def _pixels(i: Inputs) -> DataFrame:
    holed = i.pixel.select(*PIXEL, F.when((F.col("px") + F.col("py")) % 9 == 0, 0.0).otherwise(2.0).alias("depth_m"))
    return lift.seen_pixels(holed, i.gt, _poses(i))


_LOOK = f"(select s.*, depth_m, label from {_SEEN} s join {_HOLED} g using (scene_id,frame_id,px,py))"


@query(f"select scene_id, frame_id, label, count(*) n, sum(vertex_id)::bigint vertices from {_LOOK} group by all")
def j10_lookup_pixel(i):
    return lift.seen_by_label(_seen(i), _pixels(i))


@query("select a.scene_id, a.inst_id i, b.inst_id j, count(*) n from fx_inst a join fx_inst b using (scene_id, vertex_id) group by all")
def j11_mask_self_join(i):
    return instances.mask_overlaps(i.inst.select("scene_id", F.col("inst_id").alias("idx"), "vertex_id"))


_IOU = "(greatest(0,least(a.x1,b.x1)-greatest(a.x0,b.x0))*greatest(0,least(a.y1,b.y1)-greatest(a.y0,b.y0)))"
_BOX_PAIRS = f"""(select * from (select a.frame_id, a.box_id a, b.box_id b, {_IOU}/((a.x1-a.x0)*(a.y1-a.y0)+(b.x1-b.x0)*(b.y1-b.y0)-{_IOU}) iou from {_BOXES} a join {_BOXES} b
   on a.frame_id=b.frame_id and (a.score>b.score or a.score=b.score and a.box_id<b.box_id)) where iou>{{t}})"""


@query(f"select frame_id, a, b, round(iou,6) iou from {_BOX_PAIRS.format(t=0.3)}")
def j12_box_pair_join(i):
    return boxes.box_pairs(_boxes(i), 0.3).select("frame_id", "a", "b", *r6("iou"))


@query(f"select p.model_no, q.r candidate, count(*) n from fx_pred p join {_pairs('ade20k', 'wn_merged')} q on q.l=p.label where p.label_space='ade20k' group by all")
def j13_lookup_votes(i):
    pairs = vocab.space_pairs(i.vocab, "ade20k", "wn_merged")
    rows = i.pred.where("label_space = 'ade20k'").join(pairs, F.col("label") == F.col("l"))
    return rows.groupBy("model_no", F.col("r").alias("candidate")).agg(F.count("*").alias("n"))


@query(f"select label, count(*) n, label in (select id from {_ids('wn_merged')}) known from fx_gt group by 1")
def j14_semi_anti(i):
    ids = vocab.space_ids(i.vocab, "wn_merged").withColumnRenamed("id", "label")
    part = lambda how, known: i.gt.join(ids, "label", how).groupBy("label").agg(F.count("*").alias("n")).withColumn("known", F.lit(known))
    return part("left_semi", True).unionByName(part("left_anti", False))


# --- aggregations -------------------------------------------------------------------------------------------------

_RGB = {"r": 37, "g": 101, "b": 197}
_COLORED = f"(select *, {', '.join(f'vertex_id*{m}%256 {c}' for c, m in _RGB.items())} from fx_point)"
_DOMAIN = "case label_space when 'ade20k' then label between 0 and 149 when 'nyu40id' then label between 1 and 40 when 'wn199' then label between 1 and 188 else label>=0 end"
_TABLE = " union all ".join(f"select '{s}' label_space, l, r from {_pairs(s, 'wn_merged')}" for s in SPACES)


def _vote_sql(pred: str = "fx_pred", extra: str = "", least: int = 2) -> str:
    keys = f"{extra} scene_id, frame_id, px, py"
    return f"""(select {keys}, coalesce(n,0) n_votes, case when coalesce(n,0)<{least} then 0 else coalesce(cand,0) end as label from (select distinct {keys} from {pred}) left join
      (select {keys}, max(n) n, arg_max(cand, n*100000-cand) cand from (select {keys}, t.r cand, count(*) n from {pred} p join ({_TABLE}) t on t.label_space=p.label_space and t.l=p.label where {_DOMAIN.replace('label_space', 'p.label_space')} group by all) group by all) using ({keys}))"""


def _vote_table(i: Inputs) -> DataFrame:
    return vote.vote_table(i.vocab, SPACES, "wn_merged")


def _colored(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: (F.col("vertex_id") * m % 256).cast("int") for c, m in _RGB.items()})


def _voted(i: Inputs) -> DataFrame:
    return vote.vote(i.pred, _vote_table(i))


@query(f"select * from {_vote_sql()}")
def a01_vote(i):
    return _voted(i)


@query(f"select label_space, model_no, count(*) n, sum(label)::bigint total from fx_pred where {_DOMAIN} group by all")
def a02_vote_domain(i):
    return vote.vote_domain(i.pred).groupBy("label_space", "model_no").agg(F.count("*").alias("n"), F.sum("label").alias("total"))


@query(" union all ".join(f"select '{s}' space, pred_id, label_id, n from {_unmatched(s)}" for s in SPACES))
def a03_unmatched_confmat(i):
    parts = [_counts(i, s).withColumn("space", F.lit(s)) for s in SPACES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).select("space", "pred_id", "label_id", "n")


def _matched_sql(space: str, to: str = "wn_merged", lr: bool = True, keys: str = "", counts: str = "") -> str:
    back = "" if lr else f"and label_id in (select r from {_pairs(space, to)})"
    return f"""(select {keys} pred_id, label_id, sum(n)::bigint n from (
      select {keys} unnest(case when len(t.ts)>0 {back} then case when list_contains(t.ts,label_id) then [label_id] else t.ts end else [null] end) pred_id, label_id, n
      from {counts or _unmatched(space, to)} u left join (select l, list(r) ts from {_pairs(space, to)} group by l) t on t.l=u.pred_id where label_id is not null) group by all)"""


@query(
    " union all ".join([f"select '{s}' space, pred_id, label_id, n from {_matched_sql(s)}" for s in SPACES] + [f"select 'back', pred_id, label_id, n from {_matched_sql('nyu40id', 'id', False)}"])
)
def a04_match_confmat(i):
    parts = [evaluate.match_confmat(_counts(i, s), vocab.space_pairs(i.vocab, s, "wn_merged")).withColumn("space", F.lit(s)) for s in SPACES]
    back = evaluate.match_confmat(_counts(i, "nyu40id", "id"), vocab.space_pairs(i.vocab, "nyu40id", "id"), False).withColumn("space", F.lit("back"))
    out = back
    for p in parts:
        out = out.unionByName(p)
    return out.select("space", "pred_id", "label_id", "n")


@query(f"select pred_id, label_id, n from {_matched_sql('ade20k')} where pred_id is not null")
def a05_pixel_confmat(i):
    return evaluate.pixel_confmat(_counts(i, "ade20k"), vocab.space_pairs(i.vocab, "ade20k", "wn_merged"))


def _class_sql(matched: str, keys: str = "", using: str = "") -> str:
    return f"""(select {keys} coalesce(a.class_id,b.class_id) class_id, coalesce(cols,0) n_truth, case when cols>0 then d::double/(coalesce(rws,0)+cols-d) end iou, case when cols>0 then d::double/cols end acc
      from (select {using} pred_id class_id, sum(n)::bigint rws from {matched} where pred_id is not null group by all) a full join
      (select {using} label_id class_id, sum(n)::bigint cols, sum(case when pred_id=label_id then n else 0 end)::bigint d from {matched} group by all) b using ({using} class_id))"""


def _metric_sql(matched: str, using: str = "") -> str:
    on = f"using ({using.rstrip(', ')})" if using else "on true"
    return f"""(select {using} round(m_iou,6) m_iou, round(m_acc,6) m_acc, round(t_acc,6) t_acc from
      (select {using} avg(coalesce(iou,0)) m_iou, avg(coalesce(acc,0)) m_acc from {_class_sql(matched, using, using)} where n_truth>0 group by all) x join
      (select {using} sum(case when pred_id=label_id then n else 0 end)::double/sum(n) t_acc from {matched} group by all) y {on})"""


@query(" union all ".join(f"select '{s}' space, * from {_metric_sql(_matched_sql(s))}" for s in SPACES))
def a06_segmentation_metrics(i):
    matched = None
    for s in SPACES:
        part = evaluate.match_confmat(_counts(i, s), vocab.space_pairs(i.vocab, s, "wn_merged")).withColumn("space", F.lit(s))
        matched = part if matched is None else matched.unionByName(part)
    return evaluate.segmentation_metrics(matched, ["space"]).select("space", *r6("m_iou", "m_acc", "t_acc"))


_SCENE = _matched_sql("nyu40id", keys="scene_id,", counts=_unmatched("nyu40id", keys="scene_id,"))


@query(f"select scene_id, m_iou, m_acc, t_acc from {_metric_sql(_SCENE, 'scene_id, ')} union all select null, m_iou, m_acc, t_acc from {_metric_sql(_matched_sql('nyu40id'))}")
def a07_evaluate_scenes(i):
    counts = _counts(i, "nyu40id", by=["scene_id"], pred=i.pred.where("model_no = 2"))
    matched = evaluate.match_confmat(counts, vocab.space_pairs(i.vocab, "nyu40id", "wn_merged"), by=["scene_id"])
    return evaluate.evaluate_scenes(matched).select("scene_id", *r6("m_iou", "m_acc", "t_acc"))


@query("""select scene_id,frame_id,px,py, cast(trunc(round(a*mono+b,6)) as int) fitted from fx_depth left join
  (select scene_id,frame_id, regr_slope(depth_mm,mono) a, regr_intercept(depth_mm,mono) b from fx_depth where depth_mm<>0 group by all) using (scene_id,frame_id)""")
def a08_fit_affine_depth(i):
    return depth.fit_affine_depth(i.depth).select(*PIXEL, "fitted")


_PATCH = """(select t.*, count(n.mono) n, coalesce(sum(n.mono),0)::double sx, coalesce(sum(n.depth_mm),0)::double sy, coalesce(sum(n.mono::bigint*n.depth_mm),0)::double sxy, coalesce(sum(n.mono::bigint*n.mono),0)::double sxx
  from fx_depth t left join fx_depth n on n.scene_id=t.scene_id and n.frame_id=t.frame_id and n.px between t.px-4 and t.px+3 and n.py between t.py-4 and t.py+3 and n.depth_mm<>0 where t.depth_mm=0 group by all)"""


@query(f"""with patch as {_PATCH}, fit as (select *, case when n=0 then 0 when n*sxx-sx*sx<=1e-9*n*sxx then (sx/n)*(sy/n)/((sx/n)*(sx/n)+1) else (n*sxy-sx*sy)/(n*sxx-sx*sx) end a,
   case when n=0 then 0 when n*sxx-sx*sx<=1e-9*n*sxx then (sy/n)/((sx/n)*(sx/n)+1) else (sy*sxx-sx*sxy)/(n*sxx-sx*sx) end b from patch)
  select scene_id,frame_id,px,py,depth_mm completed from fx_depth where depth_mm<>0 union all
  select scene_id,frame_id,px,py, case when v=0 then mono else v end from (select *, greatest(0,cast(trunc(case when a<0.5 or a>2 then mono::double else a*mono+b end) as int)) v from fit)""")
def a09_complete_depth(i):
    return depth.complete_depth(i.depth, 4).select(*PIXEL, "completed")


@query(f"""select scene_id, label, coalesce(n,0) n, round(coalesce(n,0)/sum(coalesce(n,0)) over (partition by scene_id),6) as share from (select distinct scene_id from fx_gt)
  cross join (select distinct id as label from {_ids('wn_merged')} union select 0) left join (select scene_id,label,count(*) n from fx_gt group by all) using (scene_id,label)""")
def a10_class_histogram(i):
    ids = vocab.class_list(i.vocab, "wn_merged").select(F.col("id").alias("label"))
    return evaluate.class_histogram(i.gt, ["scene_id"], ids).select("scene_id", "label", "n", *r6("share"))


_BOUNDS = "(select scene_id, (min(tx)+max(tx))/2 center_x, (min(ty)+max(ty))/2 center_y, (min(tz)+max(tz))/2 center_z, 2e0/(greatest(max(tx)-min(tx),max(ty)-min(ty),max(tz)-min(tz))+3e0) scale from fx_pose group by 1)"


@query(f"select scene_id, round(center_x,6) center_x, round(center_y,6) center_y, round(center_z,6) center_z, round(scale,6) scale from {_BOUNDS}")
def a11_pose_bounds(i):
    return fusion.pose_bounds(i.pose).select("scene_id", *r6("center_x", "center_y", "center_z", "scale"))


@query(f"""select p.scene_id, vertex_id, coalesce(label,0) as label, coalesce(n,0) n from fx_point p left join (select scene_id, vertex_id, arg_max(label, n*100000-label) as label, max(n) n
  from (select scene_id, vertex_id, label, count(*) n from {_LOOK} where abs(z-depth_m)<=0.1 group by all) group by all) using (scene_id,vertex_id)""")
def a12_lift_votes(i):
    return lift.lift_votes(i.point, _seen(i), _pixels(i))


@query("select scene_id,frame_id,label,count(*) area from fx_gt group by all")
def a13_label_areas(i):
    return masks.label_areas(i.gt)


@query("select scene_id,frame_id,label,count(*) area,min(px) x0,min(py) y0,max(px) x1,max(py) y1 from fx_gt where label>0 group by all")
def a14_mask_area_bbox(i):
    return masks.mask_area_bbox(i.gt.where("label > 0"), ["scene_id", "frame_id", "label"])


@query("select inst_id, round(max(score)*sum(case when g>0 then 1/(1+exp(-g)) else 0 end)/(sum(case when g>0 then 1e0 else 0e0 end)+1e-6),6) quality from (select *, (vertex_id*7+inst_id)%11-5.0e0 g from fx_inst) group by 1")
def a15_mask_quality(i):
    rows = i.inst.withColumn("logit", (F.col("vertex_id") * 7 + F.col("inst_id")) % 11 - 5.0)
    return instances.mask_quality(rows, ["inst_id"]).select("inst_id", *r6("quality"))


@query("select scene_id, vertex_id, min(vertex_id) over (partition by scene_id, floor((x+1e-7)/0.1), floor((y+1e-7)/0.1), floor((z+1e-7)/0.1)) rep from fx_point")
def a16_voxel_quantize(i):
    return fusion.voxel_quantize(i.point.withColumns({c: F.col(c) + 1e-7 for c in "xyz"}), 0.1)


@query(f"select scene_id, floor((x+1e-7)/0.25)::bigint vx, floor((y+1e-7)/0.25)::bigint vy, floor((z+1e-7)/0.25)::bigint vz, round(avg(x),5) x, round(avg(y),5) y, round(avg(z),5) z, round(avg(r),5) r, round(avg(g),5) g, round(avg(b),5) b, count(*) n from {_COLORED} group by all")
def a17_voxel_downsample(i):
    out = fusion.voxel_downsample(_colored(i.point.withColumns({c: F.col(c) + 1e-7 for c in "xyz"})), 0.25, ("r", "g", "b"))
    return out.select("scene_id", "vx", "vy", "vz", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in "xyzrgb"), "n")


@query(f"""select scene_id, vx, vy, vz, round(avg(greatest(-1e0,least(1e0,(d-((vx+0.5e0)*0.05e0*dx+(vy+0.5e0)*0.05e0*dy+(vz+0.5e0)*0.05e0*dz))/0.1e0))),5)+0.0 sdf, round(avg(r),5) r, round(avg(g),5) g, round(avg(b),5) b, count(*) weight from
  (select distinct scene_id, vertex_id, d, dx, dy, dz, r, g, b, floor((x+dx*(st*0.05e0))/0.05e0)::bigint vx, floor((y+dy*(st*0.05e0))/0.05e0)::bigint vy, floor((z+dz*(st*0.05e0))/0.05e0)::bigint vz from
   (select *, x/d dx, y/d dy, z/d dz from (select *, sqrt(x*x+y*y+z*z) d from (select scene_id, vertex_id, r, g, b, x+1e-7 x, y+1e-7 y, z+1e-7 z from {_COLORED}))) cross join range(-2,3) t(st)) group by all""")
def a18_tsdf_accumulate(i):
    rays = _colored(i.point.withColumns({c: F.col(c) + 1e-7 for c in "xyz"} | {f"o{c}": F.lit(0.0) for c in "xyz"}))
    out = fusion.tsdf_accumulate(rays, 0.05, 0.1, ("r", "g", "b"))
    return out.select("scene_id", "vx", "vy", "vz", *((F.round(c, 5) + F.lit(0.0)).alias(c) for c in ("sdf", "r", "g", "b")), "weight")


@query("select scene_id,frame_id,px,py, round((mono-min(mono) over w)/(max(mono) over w-min(mono) over w+1e-8),6) scaled from fx_depth window w as (partition by scene_id,frame_id)")
def a19_minmax_per_frame(i):
    return frames.minmax_per_frame(i.depth, "mono").select(*PIXEL, *r6("scaled"))


@query(f"""select class_id, {', '.join(f"round(max(case when m='{s}' then iou end),6) {s}" for s in SPACES)} from ({' union all '.join(f"select '{s}' m, class_id, n_truth, iou from {_class_sql(_matched_sql(s))}" for s in SPACES)}) where n_truth>0 group by 1""")
def a20_report_pivot(i):
    return evaluate.report_pivot(_reports(i), SPACES).select("class_id", *(F.round(s, 6).alias(s) for s in SPACES))


def _reports(i: Inputs) -> DataFrame:
    parts = None
    for s in SPACES:
        m = evaluate.class_metrics(evaluate.match_confmat(_counts(i, s), vocab.space_pairs(i.vocab, s, "wn_merged"))).withColumn("method", F.lit(s))
        parts = m if parts is None else parts.unionByName(m)
    return parts


_REPORTED = [1, 3, 5, 7, 9]
_REPORTS = " union all ".join(f"select '{s}' m, class_id, n_truth, iou from {_class_sql(_matched_sql(s))}" for s in SPACES)


@query(f"""select m as method, cast(row_number() over (order by round(avg(coalesce(iou,0)),9) desc, m) as int) place, round(avg(coalesce(iou,0)),6) m_iou, {', '.join(f"round(max(case when class_id={c} then iou end),6) c{c}" for c in _REPORTED)} from ({_REPORTS}) where n_truth>0 group by m""")
def a20_report_methods(i):
    out = evaluate.report_methods(_reports(i), _REPORTED)
    return out.select("method", "place", *(F.round(c, 6).alias(c) for c in ("m_iou", *(f"c{c}" for c in _REPORTED))))


_VARIANT = "(select v.variant, p.* from fx_pred p cross join (select distinct model variant from fx_model union all select 'all') v where p.model<>v.variant)"


@query(f"select variant, label, count(*) n, sum(n_votes)::bigint votes from {_vote_sql(_VARIANT, 'variant,')} group by all")
def a21_leave_one_out(i):
    return vote.leave_one_out(i.pred, _vote_table(i), i.model).groupBy("variant", "label").agg(F.count("*").alias("n"), F.sum("n_votes").alias("votes"))


_IDS = f"(select distinct id from {_ids('wn_merged')})"
_VOTED_COUNTS = f"(select variant, a.id pred_id, b.id label_id, count(*) n from {_vote_sql(_VARIANT, 'variant,')} v join fx_gt g using (scene_id,frame_id,px,py) left join {_IDS} a on a.id=v.label left join {_IDS} b on b.id=g.label group by all)"
_VOTED_MATCHED = f"(select variant, pred_id, label_id, n from {_VOTED_COUNTS} where label_id is not null)"


@query(f"select variant, m_iou, m_acc, t_acc from {_metric_sql(_VOTED_MATCHED, 'variant, ')}")
def a21_leave_one_out_metrics(i):
    ids = vocab.space_ids(i.vocab, "wn_merged")
    counts = evaluate.listed_confmat(vote.leave_one_out_counts(i.pred, _vote_table(i), i.model, i.gt), ids, ids, ["variant"])
    matched = evaluate.match_confmat(counts, ids.select(F.col("id").alias("l"), F.col("id").alias("r")), by=["variant"])
    return evaluate.segmentation_metrics(matched, ["variant"]).select("variant", *r6("m_iou", "m_acc", "t_acc"))


@query("""with u as (select label, vec_id, list_transform(embedding, lambda x: x::double) e from embeddings), l as (select label, unnest(e)/sqrt(list_sum(list_transform(e, lambda x: x*x))) v, generate_subscripts(e,1)-1 pos from u),
  m as (select label, pos, avg(v) m from l group by all) select label, pos::int pos, round(m/sqrt(sum(m*m) over (partition by label)),6)+0.0 as value from m""")
def a22_class_embedding(i):
    return fusion.class_embedding(i.embeddings).select("label", "pos", *r6("value"))


@query(f"select scene_id,frame_id,px,py,vertex_id,r,g,b from (select scene_id,frame_id,px,py,max(vertex_id) vertex_id from {_LOOK} where abs(z-depth_m)<=0.1 group by all) join (select scene_id,vertex_id,r,g,b from {_COLORED}) using (scene_id,vertex_id)")
def a23_splat_points(i):
    colors = _colored(i.point).select("scene_id", "vertex_id", "r", "g", "b")
    return lift.splat_points(_seen(i), _pixels(i), colors).select(*PIXEL, "vertex_id", "r", "g", "b")


# --- windows, ranking ---------------------------------------------------------------------------------------------


@query("select scene_id,frame_id,px,py, case when max(score)<0.7 or max(case when class_idx=0 then score end)=0 then -1 else arg_max(class_idx, score*1000-class_idx*1e-3) end as label, max(score) score from fx_score group by all")
def w01_argmax_label(i):
    return instances.argmax_label(i.score, PIXEL)


@query("select scene_id, frame_id, px, py, class_idx, score, rank from (select *, cast(row_number() over (partition by scene_id order by score desc, frame_id, px, py, class_idx) as int) as rank from fx_score) where rank<=300")
def w02_topk_proposals(i):
    return instances.topk(i.score, ["scene_id"], [F.desc("score"), "frame_id", "px", "py", "class_idx"], 300)


_RANKED = "(select *, row_number() over (partition by scene_id order by score desc, inst_id)-1 idx from (select distinct scene_id, inst_id, score, class_idx from fx_inst {w}))"


@query(f"select scene_id, inst_id, score, class_idx, cast(idx as int) idx from {_RANKED.format(w='')}")
def w03_rank_instances(i):
    return instances.rank_instances(i.inst).select("scene_id", "inst_id", "score", "class_idx", "idx")


@query(f"""with r as {_RANKED.format(w='where score>=0.1')}, m as (select f.scene_id, r.idx, vertex_id from fx_inst f join r using (scene_id,inst_id)), o as (select a.scene_id, a.idx i, b.idx j, count(*) n from m a join m b using (scene_id,vertex_id) group by all),
  nn as (select *, n::double/max(n) over (partition by scene_id,j) norm from o), f as (select scene_id, i, min(j) first from nn where norm>0.05 group by all)
  select r.scene_id, r.inst_id, cast(r.idx as int) idx, r.class_idx, r.score from r left join f on f.scene_id=r.scene_id and f.i=r.idx where f.first is null or f.first=r.idx""")
def w04_suppress_overlaps(i):
    return instances.suppress_overlaps(i.inst, 0.05)


@query(f"select f.scene_id, vertex_id, arg_max(r.class_idx, idx) class_idx from fx_inst f join {_RANKED.format(w='')} r using (scene_id,inst_id) group by all")
def w05_paint_last_wins(i):
    return instances.paint_last_wins(i.inst, instances.rank_instances(i.inst))


@query("select scene_id, vertex_id, arg_max(class_idx, score*1e6-inst_id*1e-3) class_idx from fx_inst group by all")
def w06_paint_first_wins(i):
    return instances.paint_first_wins(i.inst)


def _masks(i: Inputs) -> DataFrame:
    return i.pred.where("label % 3 = 0").select(*PIXEL, F.col("model_no").alias("mask_id"), F.col("label").alias("class_idx"))


@query("""with m as (select scene_id,frame_id,px,py,model_no mask_id,label class_idx from fx_pred where label%3=0), a as (select scene_id,frame_id,mask_id,count(*) area from m group by all)
  select g.scene_id,g.frame_id,g.px,g.py,coalesce(b.label,0) as label from fx_pixel g left join (select m.scene_id,m.frame_id,px,py,arg_min(class_idx, area*100+mask_id) as label from m join a using (scene_id,frame_id,mask_id) group by all) b using (scene_id,frame_id,px,py)""")
def w07_smallest_mask_wins(i):
    return instances.smallest_mask_wins(_masks(i), i.pixel, PIXEL)


@query("""with recursive h as (select *, row_number() over (partition by scene_id,frame_id,px,py order by inst_idx) n, count(*) over (partition by scene_id,frame_id,px,py) m from fx_hit),
  z as (select scene_id,frame_id,px,py,n,m,inst_idx,t from h where n=1 union all select h.scene_id,h.frame_id,h.px,h.py,h.n,h.m,case when z.t>h.t+0.05 then h.inst_idx else z.inst_idx end, case when z.t>h.t+0.05 then h.t else z.t end
   from z join h on h.scene_id=z.scene_id and h.frame_id=z.frame_id and h.px=z.px and h.py=z.py and h.n=z.n+1) select scene_id,frame_id,px,py,inst_idx,t from z where n=m""")
def w08_zbuffer_fold(i):
    return instances.zbuffer_fold(i.hit, PIXEL)


@query(f"""with recursive o as (select frame_id, b box_id, list(a) losers from {_BOX_PAIRS.format(t=0.3)} group by 1,2), h as (select x.frame_id, x.box_id, coalesce(o.losers, []) losers, row_number() over (partition by x.frame_id order by x.score desc, x.box_id) n,
   count(*) over (partition by x.frame_id) m from {_BOXES} x left join o on o.frame_id=x.frame_id and o.box_id=x.box_id),
  z as (select frame_id, n, m, [box_id] kept from h where n=1 union all select h.frame_id, h.n, h.m, case when list_has_any(z.kept, h.losers) then z.kept else list_append(z.kept, h.box_id) end from z join h on h.frame_id=z.frame_id and h.n=z.n+1)
  select k.frame_id, k.box_id, b.score from (select frame_id, unnest(kept) box_id from z where n=m) k join {_BOXES} b using (frame_id, box_id)""")
def w09_nms_boxes(i):
    return boxes.nms_boxes(_boxes(i), 0.3).select("frame_id", "box_id", "score")


@query("""select frame_id, box_id, cast(arg_max(tag, score*1000-tag*1e-3) as int) tag, max(score) score from (select frame_id, box_id, tag, max(score) score from
  (select cast(frame_id as int) frame_id, px%4 box_id, class_idx%3 tag, score, (py+class_idx)%5=0 sep from fx_score) where score>0.2 and not sep group by all) group by 1,2""")
def w10_best_tag_per_box(i):
    tokens = i.score.select("frame_id", (F.col("px") % 4).alias("box_id"), (F.col("class_idx") % 3).alias("tag"), "score", ((F.col("py") + F.col("class_idx")) % 5 == 0).alias("separator"))
    return boxes.best_tag_per_box(tokens)


@query("select scene_id, us, cast(row_number() over (partition by scene_id order by us)-1 as int) new_id from (select distinct scene_id, us from fx_sensor where kind='error')")
def w11_rank_frames(i):
    return frames.rank_frames(_sensor(i, "error"), "us").select("scene_id", "us", "new_id")


_BRACKET = """(select c.scene_id, c.us, max(case when t.us<=c.us then t.us end) p, min(case when t.us>=c.us then t.us end) n from (select distinct scene_id, us from fx_sensor where kind='click') c
  join fx_traj t using (scene_id) group by 1,2)"""


@query(f"select scene_id, us, p prev_us, n next_us from {_BRACKET}")
def w12_bracket_pose(i):
    return sync.bracket_pose(_sensor(i, "click"), i.traj).select("scene_id", "us", F.col("prev.us").alias("prev_us"), F.col("next.us").alias("next_us"))


@query("select scene_id, frame_id, label, count(*) area, cast(row_number() over (partition by scene_id, frame_id order by count(*) desc, label) as int) as rank from fx_gt group by 1,2,3")
def w13_sorted_areas(i):
    from pyspark.sql import Window

    area = masks.label_areas(i.gt)
    return area.withColumn("rank", F.row_number().over(Window.partitionBy("scene_id", "frame_id").orderBy(F.desc("area"), "label")))


# --- set operations -----------------------------------------------------------------------------------------------


@query("select model, scene_id, count(*) n from fx_pred where model in ('cmx','ovseg') group by all")
def u01_union_voters(i):
    part = lambda m: i.pred.where(F.col("model") == m)
    return part("cmx").unionByName(part("ovseg")).groupBy("model", "scene_id").agg(F.count("*").alias("n"))


@query("select 'gt' source, label, count(*) n from fx_gt group by 2 union all select 'cmx', label, count(*) from fx_pred where model='cmx' group by 2")
def u02_union_reports(i):
    report = lambda name, rows: rows.groupBy("label").agg(F.count("*").alias("n")).withColumn("source", F.lit(name))
    return report("gt", i.gt).unionByName(report("cmx", i.pred.where("model = 'cmx'"))).select("source", "label", "n")


@query("select distinct scene_id, frame_id from fx_pixel where frame_id%4=1")
def u03_set_except(i):
    keys = i.pixel.select("scene_id", "frame_id").distinct()
    return keys.exceptAll(keys.where("frame_id % 4 <> 1"))


@query("select distinct label_space, label from fx_pred")
def u04_distinct_ids(i):
    return i.pred.select("label_space", "label").distinct()


@query(f"select scene_id, us from {_nearest_sql()} where abs(us-ts[1])<{DT_MAX} intersect select scene_id, us from {_nearest_sql(target='error')} where abs(us-ts[1])<{DT_MAX}")
def u05_intersect_valid(i):
    valid = lambda k: sync.nearest_timestamp(_sensor(i, "click"), _sensor(i, k)).where(F.col("dt") < DT_MAX).select("scene_id", "us")
    return valid("purchase").intersect(valid("error"))


# --- geometry -----------------------------------------------------------------------------------------------------


def _elements(rows: DataFrame, column: str, key: str = "frame_id") -> DataFrame:
    return rows.select(key, F.posexplode(column).alias("pos", "v")).select(key, "pos", *r6("v"))


_INVERSE = "list_value(c,s,0,-(c*tx+s*ty), -s,c,0,s*tx-c*ty, 0,0,1,-tz, 0,0,0,1)"


@query(f"select frame_id, cast(p-1 as int) pos, round(m[p],6)+0.0 v from (select frame_id, {_INVERSE} m from fx_pose) cross join range(1,17) t(p)")
def m01_rigid_inverse(i):
    return _elements(_poses(i).withColumn("m", G.rigid_inverse(F.col("pose"))), "m")


@query("select frame_id, cast(p-1 as int) pos, round(m[p],6)+0.0 v from (select frame_id, list_value(c/2,s/2,0,-(c*tx+s*ty)/2, -s/2,c/2,0,(s*tx-c*ty)/2, 0,0,0.5,-tz/2, 0,0,0,1) m from fx_pose) cross join range(1,17) t(p)")
def m02_affine_inverse(i):
    # a pose scaled by two has no orthonormal rotation
    scaled = F.transform("pose", lambda x, k: F.when((k % 4 < 3) & (k < 12), x * 2).otherwise(x))
    return _elements(_poses(i).withColumn("p", scaled).withColumn("m", G.affine_inverse(F.col("p"))), "m")


@query("select frame_id, cast(p-1 as int) pos, round(m[p],6)+0.0 v from (select frame_id, list_value(c*c-s*s,-2*c*s,0,c*tx-s*ty+tx, 2*c*s,c*c-s*s,0,s*tx+c*ty+ty, 0,0,1,2*tz, 0,0,0,1) m from fx_pose) cross join range(1,17) t(p)")
def m03_matmul4(i):
    return _elements(_poses(i).withColumn("m", G.matmul4(F.col("pose"), F.col("pose"))), "m")


@query(f"select scene_id, frame_id, vertex_id, px, py, round(z,6) z from {_SEEN}")
def m04_project_points(i):
    return lift.expand_seen(_seen(i), i.point, _poses(i)).select("scene_id", "frame_id", "vertex_id", "px", "py", *r6("z"))


@query("""select d.scene_id,d.frame_id,px,py, round(c*a-s*b+tx,8)+0.0 x, round(s*a+c*b+ty,8)+0.0 y, round(z+tz,8)+0.0 z from (select *, (px-8)*(depth_mm/1000e0)/8 a, (py-6)*(depth_mm/1000e0)/8 b, depth_mm/1000e0 z from fx_depth where depth_mm>0) d
  join fx_pose using (scene_id,frame_id)""")
def m05_backproject_depth(i):
    rows = i.depth.where("depth_mm > 0").join(_poses(i).select("scene_id", "frame_id", "pose"), ["scene_id", "frame_id"])
    xyz = G.backproject(F.col("pose"), F.col("px"), F.col("py"), F.col("depth_mm") / 1000.0, 8.0, 8.0, 8.0, 6.0)
    return rows.select(*PIXEL, *((F.round(v, 8) + F.lit(0.0)).alias(c) for v, c in zip(xyz, "xyz")))


@query(f"select scene_id, frame_id, round((tx-center_x)*scale,6)+0.0 tx, round((ty-center_y)*scale,6)+0.0 ty, round((tz-center_z)*scale,6)+0.0 tz from fx_pose join {_BOUNDS} using (scene_id)")
def m06_normalize_scene(i):
    return fusion.normalize_scene(i.pose, fusion.pose_bounds(i.pose)).select("scene_id", "frame_id", *r6("tx", "ty", "tz"))


_ROTATION = [["c+x*x*(1-c)", "x*y*(1-c)-z*s", "x*z*(1-c)+y*s"], ["y*x*(1-c)+z*s", "c+y*y*(1-c)", "y*z*(1-c)-x*s"], ["z*x*(1-c)-y*s", "z*y*(1-c)+x*s", "c+z*z*(1-c)"]]


@query(f"""select scene_id, us, {', '.join(f"round({_ROTATION[k // 3][k % 3]},6)+0.0 r{k}" for k in range(9))} from (select *, rx/a x, ry/a y, rz/a z, cos(a) c, sin(a) s from (select *, sqrt(rx*rx+ry*ry+rz*rz) a from fx_traj))""")
def m07_rotvec_to_matrix(i):
    out = sync.pose_matrices(i.traj)
    return out.select("scene_id", "us", *((F.round(F.col("r")[k], 6) + F.lit(0.0)).alias(f"r{k}") for k in range(9)))


_QUATERNION = "(select *, cos(n/2) qw, rx*sin(n/2)/n qx, ry*sin(n/2)/n qy, rz*sin(n/2)/n qz from (select *, sqrt(rx*rx+ry*ry+rz*rz) n from fx_traj))"


@query(f"""with q as {_QUATERNION}, b as (select *, case when n=p then 0 else (us-p)/(n-p)::double end w from {_BRACKET} where p is not null and n is not null),
  d as (select b.scene_id, b.us, w, a.tx+w*(c.tx-a.tx) tx, a.ty+w*(c.ty-a.ty) ty, a.tz+w*(c.tz-a.tz) tz, a.qw aw, a.qx ax, a.qy ay, a.qz az, c.qw cw, c.qx cx, c.qy cy, c.qz cz, a.qw*c.qw+a.qx*c.qx+a.qy*c.qy+a.qz*c.qz dot
    from b join q a on a.scene_id=b.scene_id and a.us=b.p join q c on c.scene_id=b.scene_id and c.us=b.n),
  e as (select *, acos(least(1e0,abs(dot))) o, case when dot<0 then -1e0 else 1e0 end g from d),
  f as (select *, case when sin(o)<1e-9 then 1-w else sin((1-w)*o)/sin(o) end u, g*case when sin(o)<1e-9 then w else sin(w*o)/sin(o) end v from e)
  select scene_id, us, {', '.join(f'round(t{c},6)+0.0 t{c}' for c in 'xyz')}, {', '.join(f'round(u*a{c}+v*c{c},5)+0.0 q{c}' for c in 'wxyz')} from f""")
def m08_interpolate_pose(i):
    out = sync.interpolate_pose(sync.bracket_pose(_sensor(i, "click"), i.traj))
    return out.select("scene_id", "us", *r6("tx", "ty", "tz"), *((F.round(f"q{c}", 5) + F.lit(0.0)).alias(f"q{c}") for c in "wxyz"))


_AXES = ("tx", "ty", "tz")
_RIGHT = ", ".join(f"6*((lead({c}) over w-{c})/h1-({c}-lag({c}) over w)/h0) r{c}" for c in _AXES)


def _spline_sql(ends: str) -> str:
    """DuckDB: the spline's value at each click, by elimination along each scene; names end in the kind of its ends."""
    e = "_" + ends[:3]
    free = ends != "natural"
    low, diag, up = "h0", "2*(h0+h1)", "h1"
    if free:
        low, up = "case when i=1 then 0 when i=n-2 then h0-h1*h1/h0 else h0 end", "case when i=n-2 then 0 when i=1 then h1-h0*h0/h1 else h1 end"
        diag = "case when n=3 then 3*(h0+h1) when i=1 then 2*(h0+h1)+h0+h0*h0/h1 when i=n-2 then 2*(h0+h1)+h1+h1*h1/h0 else 2*(h0+h1) end"
    each = lambda text: ", ".join(text.format(c=c) for c in _AXES)
    outer = lambda c, i, j, a, b: f"case when x.n=3 then p.m{c} else (({a}+{b})*p.m{c}-{a}*q.m{c})/{b} end" if free else "0e0"
    return f"""e{e} as (select scene_id,i,n,{low} l,{diag} d,{up} u,{each('r{c}')} from knot where i between 1 and n-2),
  f{e} as (select scene_id,i,n,u/d g,{each('r{c}/d r{c}')} from e{e} where i=1 union all select e.scene_id,e.i,e.n,e.u/(e.d-e.l*f.g),{each('(e.r{c}-e.l*f.r{c})/(e.d-e.l*f.g)')} from f{e} f join e{e} e on e.scene_id=f.scene_id and e.i=f.i+1),
  s{e} as (select scene_id,i,n,{each('r{c} m{c}')} from f{e} where i=n-2 union all select f.scene_id,f.i,f.n,{each('f.r{c}-f.g*s.m{c}')} from s{e} s join f{e} f on f.scene_id=s.scene_id and f.i=s.i-1),
  m{e} as (select scene_id,i,{each('m{c}')} from s{e} union all select x.scene_id,0,{', '.join(outer(c, 1, 2, 'x.h0', 'x.h1') for c in _AXES)} from knot x join s{e} p on p.scene_id=x.scene_id and p.i=1 left join s{e} q on q.scene_id=x.scene_id and q.i=2 where x.i=1
   union all select x.scene_id,x.n-1,{', '.join(outer(c, 1, 2, 'x.h1', 'x.h0') for c in _AXES)} from knot x join s{e} p on p.scene_id=x.scene_id and p.i=x.n-2 left join s{e} q on q.scene_id=x.scene_id and q.i=x.n-3 where x.i=x.n-2),
  v{e} as (select '{ends}' as ends, t.scene_id, t.us, {', '.join(f"coalesce(a.m{c},0)*(b.us-t.us)**3/(6e18*a.h1)+coalesce(b.m{c},0)*(t.us-a.us)**3/(6e18*a.h1)+(a.{c}/a.h1-coalesce(a.m{c},0)*a.h1/6)*(b.us-t.us)/1e6+(b.{c}/a.h1-coalesce(b.m{c},0)*a.h1/6)*(t.us-a.us)/1e6 {c}" for c in _AXES)}
   from (select distinct scene_id, us from fx_sensor where kind='click') t join (select k.*, {each('m{c}')} from knot k left join m{e} using (scene_id,i)) a on a.scene_id=t.scene_id and a.us<=t.us
   join (select k.*, {each('m{c}')} from knot k left join m{e} using (scene_id,i)) b on b.scene_id=a.scene_id and b.i=a.i+1 and (t.us<b.us or t.us=b.us and b.i=b.n-1))"""


@query(f"""with recursive knot as (select *, {_RIGHT} from (select *, (us-lag(us) over w)/1e6 h0, (lead(us) over w-us)/1e6 h1, row_number() over w-1 i, count(*) over (partition by scene_id) n
   from (select scene_id, us, tx, ty, tz from fx_traj qualify row_number() over (partition by scene_id, us order by tx, ty, tz)=1) window w as (partition by scene_id order by us)) window w as (partition by scene_id order by us)),
  {_spline_sql('natural')}, {_spline_sql('not-a-knot')}
  select ends, scene_id, us, {', '.join(f'round({c},3)+0.0 {c}' for c in _AXES)} from (select * from v_nat union all select * from v_not)""")
def m08_cubic_translation(i):
    found = None
    for ends in ("natural", "not-a-knot"):
        one = spline.spline_positions(_sensor(i, "click"), spline.spline_pieces(i.traj, ends, block=86_400_000_000)).withColumn("ends", F.lit(ends))
        found = one if found is None else found.unionByName(one)
    return found.select("ends", "scene_id", "us", *((F.round(c, 3) + F.lit(0.0)).alias(c) for c in _AXES))


@query(f"select frame_id, a, b, round(iou,6) iou, round(1-iou,6) distance from {_BOX_PAIRS.format(t=0.1)}")
def m09_box_iou(i):
    return boxes.box_pairs(_boxes(i), 0.1).select("frame_id", "a", "b", "iou", (1 - F.col("iou")).alias("distance")).select("frame_id", "a", "b", *r6("iou", "distance"))


@query("select scene_id, frame_id, 8.0::double fx, 8.0::double fy, round(-s*-1,6)+0.0 m1, round(tx,6)+0.0 tx from fx_pose")
def m10_camera_path(i):
    # rendering looks along -z with y up: columns 1 and 2 change their sign
    flip = F.array(*(F.lit(float(v)) for v in (1, 0, 0, 0, 0, -1, 0, 0, 0, 0, -1, 0, 0, 0, 0, 1)))
    rows = _poses(i).withColumn("m", G.matmul4(F.col("pose"), flip))
    return rows.select("scene_id", "frame_id", F.lit(8.0).alias("fx"), F.lit(8.0).alias("fy"), F.col("m")[1].alias("m1"), F.col("m")[3].alias("tx")).select("scene_id", "frame_id", "fx", "fy", *r6("m1", "tx"))


@query("select id, round((cast(split_part(color,'-',1) as int)/255e0-0.47793)/0.27765,6) r, round((cast(split_part(color,'-',2) as int)/255e0-0.44302)/0.26846,6) g from fx_vocab")
def m11_normalize_colors(i):
    rgb = vocab.color_of(F.col("color"))
    return i.vocab.select("id", G.normalize_color(rgb[0], 0.47793, 0.27765).alias("r"), G.normalize_color(rgb[1], 0.44302, 0.26846).alias("g")).select("id", *r6("r", "g"))


_MASK = ["scene_id", "frame_id", "model_no"]


def _sparse_masks(i: Inputs) -> DataFrame:
    return i.pred.where("(label * 7 + k) % 3 = 0").select(*_MASK, "px", "py")


_SPARSE = "(select scene_id,frame_id,model_no,px,py from fx_pred where (label*7+k)%3=0)"


@query(f"select distinct scene_id,frame_id,model_no,px+dx px,py+dy py from {_SPARSE} cross join (values (0,0),(1,0),(-1,0),(0,1),(0,-1)) d(dx,dy) where px+dx between 0 and 15 and py+dy between 0 and 11")
def m12_binary_dilate(i):
    return masks.binary_dilate(_sparse_masks(i), _MASK, WIDTH, HEIGHT)


@query(f"""with recursive m as (select *, py*16+px id from {_SPARSE}), r as (select scene_id,frame_id,model_no,px,py,id,id root from m union
   select b.scene_id,b.frame_id,b.model_no,b.px,b.py,b.id,r.root from r join m b on b.scene_id=r.scene_id and b.frame_id=r.frame_id and b.model_no=r.model_no and abs(b.px-r.px)<=1 and abs(b.py-r.py)<=1 where r.root<b.id)
  select scene_id::bigint scene_id,frame_id::bigint frame_id,model_no::bigint model_no,count(distinct c) n_components from (select scene_id,frame_id,model_no,id,min(root) c from r group by all) group by 1,2,3""")
def m13_mask_components(i):
    return masks.mask_components(_sparse_masks(i), _MASK)


@query(f"""with recursive m as (select *, py*16+px id from {_SPARSE}), r as (select scene_id,frame_id,model_no,px,py,id,id root from m union
   select b.scene_id,b.frame_id,b.model_no,b.px,b.py,b.id,r.root from r join m b on b.scene_id=r.scene_id and b.frame_id=r.frame_id and b.model_no=r.model_no and abs(b.px-r.px)<=1 and abs(b.py-r.py)<=1 where r.root<b.id),
  few as (select scene_id,frame_id,model_no from (select scene_id,frame_id,model_no,id,min(root) c from r group by all) group by all having count(distinct c)<8)
  select scene_id,frame_id,model_no,px,py from {_SPARSE} join few using (scene_id,frame_id,model_no)""")
def m13_fragment_filter(i):
    return masks.fragment_filter(_sparse_masks(i), _MASK, 8)


# --- the rest of the sources --------------------------------------------------------------------------------------


@query(f"select scene_id, line, k-1 pos, round(m[k],6)+0.0 v from (select scene_id, row_number() over (partition by scene_id order by frame_id)-1 line, {_POSE} m from fx_pose) cross join range(1,17) t(k)")
def s04_read_pose_lines(i):
    path = files.scratch(i.spark, "poses")
    text = F.array_join(F.transform("pose", lambda x: x.cast("string")), " ")
    # a scene's trajectory is one file, so its lines are one task's: in order, by one writer
    _poses(i).select("scene_id", "frame_id", text.alias("value")).repartition("scene_id").sortWithinPartitions("scene_id", "frame_id").drop("frame_id").write.partitionBy("scene_id").text(path)
    rows = files.read_pose_lines(i.spark, path)
    return rows.select("scene_id", "line", F.posexplode("pose").alias("pos", "v")).select("scene_id", "line", "pos", *r6("v"))


@query("select scene_id, inst_id, count(*) n, sum(vertex_id)::bigint vertices from fx_inst group by all")
def s14_write_instance_predictions(i):
    path = files.scratch(i.spark, "instances")
    files.write_instance_predictions(i.inst, path)
    return i.spark.read.parquet(f"{path}/masks").groupBy("scene_id", "inst_id").agg(F.count("*").alias("n"), F.sum("vertex_id").alias("vertices"))


@query("select scene_id, count(*) n, sum(label)::bigint total from (select scene_id, case when scene_id=1 then label+1 else label end as label from fx_gt) group by 1")
def s16_overwrite_scenes(i):
    path = files.scratch(i.spark, "overwrite")
    files.write_label_frames(frames.to_frame_arrays(i.gt, WIDTH), path)
    changed = i.gt.where("scene_id = 1").withColumn("label", F.col("label") + 1)
    files.write_label_frames(frames.to_frame_arrays(changed, WIDTH), path)
    return frames.from_frame_arrays(i.spark.read.parquet(path), WIDTH).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("label").alias("total"))


@query("select scene_id, count(*) n, sum(label)::bigint total from fx_gt group by 1")
def s16_skip_existing(i):
    path = files.scratch(i.spark, "existing")
    files.write_label_frames(frames.to_frame_arrays(i.gt, WIDTH), path)
    changed = i.gt.withColumn("label", F.col("label") + 1)
    files.write_label_frames(frames.to_frame_arrays(changed, WIDTH), path, mode="ignore")
    return frames.from_frame_arrays(i.spark.read.parquet(path), WIDTH).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("label").alias("total"))
