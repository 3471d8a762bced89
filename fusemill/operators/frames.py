"""Frames: manifests, sampling, projections of pixels, joins of modalities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PIXEL = ["scene_id", "frame_id", "px", "py"]
SPACES = ("ade20k", "nyu40", "scannet200", "wordnet", "scannet")


def frame_manifest(paths: DataFrame) -> DataFrame:
    """path, modality, frame_id of paths whose stem is a number."""
    stem = F.regexp_extract("path", r"([^/]+)/0*(\d+)\.\w+$", 2)
    return paths.select("path", F.regexp_extract("path", r"([^/]+)/0*(\d+)\.\w+$", 1).alias("modality"), stem.try_cast("int").alias("frame_id")).where("frame_id is not null")


def predictor_catalog(folders: DataFrame) -> DataFrame:
    """folder, label_space, model, version, flip of <space>_<model>_<version>[_flip]; unknown spaces are left out."""
    part = F.split("folder", "_")
    out = folders.select("folder", part[0].alias("label_space"), part[1].alias("model"), part[2].alias("version"), F.col("folder").endswith("_flip").alias("flip"))
    return out.where(F.col("label_space").isin(*SPACES))


def sample_frames(rows: DataFrame, n: int) -> DataFrame:
    """Rows of every n-th frame of a scene, in order, from the first on."""
    frames = rows.select("scene_id", "frame_id").distinct()
    rank = F.row_number().over(Window.partitionBy("scene_id").orderBy("frame_id"))
    return rows.join(frames.withColumn("__n", rank).where((F.col("__n") - 1) % n == 0).drop("__n"), ["scene_id", "frame_id"], "left_semi")


def frame_subkey(frame: Column, stride: int) -> Column:
    return F.floor(frame / stride).cast("int")


def flip_pixels(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("px", F.lit(width - 1) - F.col("px"))


def _nearest_taps(spark: SparkSession, axis: str, n: int, m: int) -> DataFrame:
    """to_<axis>, <axis>: for each of m target positions the source position of n at floor(position * n / m)."""
    return spark.range(m).select(F.col("id").cast("int").alias(f"to_{axis}"), F.floor(F.col("id") * n / m).cast("int").alias(axis))


def _linear_taps(spark: SparkSession, axis: str, n: int, m: int) -> DataFrame:
    """to_<axis>, <axis>, w_<axis>: the two source positions of each target position and their weights."""
    src = (F.col("id") + 0.5) * (n / m) - 0.5
    low = F.floor(src)
    clamp = lambda x: F.least(F.greatest(x, F.lit(0)), F.lit(n - 1)).cast("int")
    each = F.array(F.struct(clamp(low).alias("p"), (1 - (src - low)).alias("w")), F.struct(clamp(low + 1).alias("p"), (src - low).alias("w")))
    return spark.range(m).select(F.col("id").cast("int").alias(f"to_{axis}"), F.explode(each).alias("e")).select(f"to_{axis}", F.col("e.p").alias(axis), F.col("e.w").alias(f"w_{axis}"))


def resample_nearest(rows: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Rasters of another size: each pixel takes the one at floor(position * source / target).

    Rows meet the positions of each axis, two tables as long as the target's sides, whatever the number of frames.
    """
    out = rows.select(*PIXEL, value)
    for axis, n, m in zip(("px", "py"), size, to):
        out = out.join(_nearest_taps(rows.sparkSession, axis, n, m), axis)
    return out.select("scene_id", "frame_id", F.col("to_px").alias("px"), F.col("to_py").alias("py"), value)


def resample_bilinear(rows: DataFrame, value: str, size: tuple[int, int], to: tuple[int, int]) -> DataFrame:
    """Half-pixel centres, clamped at the edges; missing values count as they are stored."""
    out = rows.select(*PIXEL, value)
    for axis, n, m in zip(("px", "py"), size, to):
        out = out.join(_linear_taps(rows.sparkSession, axis, n, m), axis)
    weighted = F.sum(F.col("w_px") * F.col("w_py") * F.col(value)).alias(value)
    return out.groupBy("scene_id", "frame_id", F.col("to_px").alias("px"), F.col("to_py").alias("py")).agg(weighted)


def scale_intrinsics(rows: DataFrame, sx: float, sy: float) -> DataFrame:
    return rows.withColumns({"fx": F.col("fx") * sx, "cx": F.col("cx") * sx, "fy": F.col("fy") * sy, "cy": F.col("cy") * sy})


def mask_low_confidence(depth: DataFrame, conf: DataFrame, least: int = 2) -> DataFrame:
    out = depth.join(conf.select(*PIXEL, "conf"), PIXEL)
    return out.withColumn("depth_mm", F.when(F.col("conf") < least, 0).otherwise(F.col("depth_mm"))).drop("conf")


def depth_metres(depth: DataFrame, scale: float = 1000.0, truncate: float | None = 3.0) -> DataFrame:
    out = depth.withColumn("depth_m", F.col("depth_mm") / scale)
    return out if truncate is None else out.where(F.col("depth_m") <= truncate)


def clip_unknown_labels(rows: DataFrame, max_id: int) -> DataFrame:
    return rows.withColumn("label", F.when(F.col("label") > max_id, 0).otherwise(F.col("label")))


def label_range_violations(rows: DataFrame, maximum: int) -> DataFrame:
    """scene_id, frame_id, largest of frames with a label above maximum; none is to be expected."""
    return rows.groupBy("scene_id", "frame_id").agg(F.max("label").alias("largest")).where(F.col("largest") > maximum)


def join_modalities(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    return reduce(lambda a, b: a.join(b, keys), tables)


def check_key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, and which side: left or right. Keys are made distinct before they meet: a key's rows on the other side are never held."""
    a, b = a.select(*keys).distinct(), b.select(*keys).distinct()
    left = a.join(b, keys, "left_anti").withColumn("only_in", F.lit("left"))
    return left.unionByName(b.join(a, keys, "left_anti").withColumn("only_in", F.lit("right")))


def check_counts(pred: DataFrame) -> DataFrame:
    """scene_id, model, n_frames of models with fewer frames than the scene's largest number."""
    n = pred.groupBy("scene_id", "model").agg(F.count_distinct("frame_id").alias("n_frames"))
    return n.withColumn("most", F.max("n_frames").over(Window.partitionBy("scene_id"))).where("n_frames < most").drop("most")


def rank_frames(rows: DataFrame, order: str) -> DataFrame:
    """rows with new_id, contiguous from 0 in a scene, and its six-digit name."""
    out = rows.withColumn("new_id", F.row_number().over(Window.partitionBy("scene_id").orderBy(order)) - 1)
    return out.withColumn("name", F.lpad(F.col("new_id").cast("string"), 6, "0"))


def minmax_per_frame(rows: DataFrame, value: str) -> DataFrame:
    """(x - min) / (max(x - min) + 1e-8) in each frame."""
    w = Window.partitionBy("scene_id", "frame_id")
    low = F.min(value).over(w)
    return rows.withColumn("scaled", (F.col(value) - low) / (F.max(value).over(w) - low + 1e-8))


def to_frame_arrays(rows: DataFrame, width: int) -> DataFrame:
    """scene_id, frame_id, labels: one array for each frame, row by row."""
    at = (F.col("py") * width + F.col("px")).alias("at")
    return rows.groupBy("scene_id", "frame_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "label"))), lambda x: x["label"]).alias("labels"))


def from_frame_arrays(frames: DataFrame, width: int) -> DataFrame:
    out = frames.select("scene_id", "frame_id", F.posexplode("labels").alias("at", "label"))
    return out.select("scene_id", "frame_id", (F.col("at") % width).cast("int").alias("px"), F.floor(F.col("at") / width).cast("int").alias("py"), "label")
