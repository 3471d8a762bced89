"""Alignment of sensor streams by time, without a join of all pairs: windows carry the neighbours."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.functions.geometry import rotvec_to_matrix

#: Microseconds of a scene that are one window.
BUCKET = 3_600_000_000


def dedupe_timestamps(rows: DataFrame) -> DataFrame:
    """scene_id, kind, us, event_id: one row for each time of a sensor, the first by id."""
    return rows.groupBy("scene_id", "kind", "us").agg(F.min("event_id").alias("event_id"))


def beside(rows: DataFrame, target: DataFrame, strict: tuple[bool, bool], bucket: int = BUCKET) -> DataFrame:
    """rows with b and a: the target row (a struct) before, and after, each time; strict: whether an equal time is left out.

    Windows are cut by scene and time bucket, so a long scene is many groups; what
    lies beyond a bucket is carried in by a window over one row a bucket. Both
    neighbours come from frames that begin at the partition's start, which Spark
    extends row by row; the later one from the falling order.
    """
    extra = [c for c in rows.columns if c not in ("scene_id", "us")]
    kind = F.struct(*target.columns)
    t = target.select("scene_id", "us", kind.alias("row"), *(F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra), F.lit(False).alias("is_ref"))
    both = rows.select("scene_id", "us", F.lit(None).cast(t.schema["row"].dataType).alias("row"), *extra, F.lit(True).alias("is_ref")).unionByName(t)
    both = both.withColumn("k", F.floor(F.col("us") / bucket).cast("long"))
    inside = Window.partitionBy("scene_id", "k")
    ends = [-1 if s else 0 for s in strict]
    found = both.withColumns(
        {
            "b": F.last("row", True).over(inside.orderBy("us").rangeBetween(Window.unboundedPreceding, ends[0])),
            "a": F.last("row", True).over(inside.orderBy(F.desc("us")).rangeBetween(Window.unboundedPreceding, ends[1])),
        }
    ).where("is_ref")
    by = both.groupBy("scene_id", "k").agg(F.max_by("row", F.when(F.col("row").isNotNull(), F.col("us"))).alias("most"), F.min_by("row", F.when(F.col("row").isNotNull(), F.col("us"))).alias("least"))
    scene = Window.partitionBy("scene_id")
    edges = by.select(
        "scene_id",
        "k",
        F.last("most", True).over(scene.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.last("least", True).over(scene.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)).alias("after"),
    )
    return found.join(edges, ["scene_id", "k"]).select("scene_id", "us", *extra, F.coalesce("b", "before").alias("b"), F.coalesce("a", "after").alias("a"))


def numbered(rows: DataFrame, name: str = "frame_id", bucket: int = BUCKET) -> DataFrame:
    """rows with their place (from 0) in their scene by time: places in a bucket plus the rows of earlier buckets."""
    keyed = rows.withColumn("__k", F.floor(F.col("us") / bucket).cast("long"))
    counts = keyed.groupBy("scene_id", "__k").agg(F.count("*").alias("n"))
    before = Window.partitionBy("scene_id").orderBy("__k").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("scene_id", "__k", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__from"))
    place = F.row_number().over(Window.partitionBy("scene_id", "__k").orderBy("us")) - 1
    return keyed.withColumn(name, place).join(offsets, ["scene_id", "__k"]).withColumn(name, (F.col(name) + F.col("__from")).cast("int")).drop("__k", "__from")


def nearest_timestamp(ref: DataFrame, target: DataFrame, tie_later: bool = False, bucket: int = BUCKET) -> DataFrame:
    """ref (scene_id, us) with match, dt and margin: the nearest time of target, its distance, and how much farther the second is.

    Times of target are distinct in a scene. Ties go to the earlier time, or to the later.
    """
    times = target.select("scene_id", "us")
    chained = beside(times, times, (True, True), bucket).select("scene_id", "us", F.col("b.us").alias("prev"), F.col("a.us").alias("next"))
    found = beside(ref.select("scene_id", "us"), chained, (True, False), bucket)
    sign = -1 if tie_later else 1
    near = F.filter(F.array("b.us", "b.prev", "a.us", "a.next"), lambda x: x.isNotNull())
    ranked = F.array_sort(F.transform(near, lambda x: F.struct(F.abs(x - F.col("us")).alias("dt"), (x * sign).alias("k"), x.alias("m"))))
    out = found.select("scene_id", "us", ranked.alias("r"))
    return out.select("scene_id", "us", F.get("r", F.lit(0))["m"].alias("match"), F.get("r", F.lit(0))["dt"].alias("dt"), (F.get("r", F.lit(1))["dt"] - F.get("r", F.lit(0))["dt"]).alias("margin"))


def synchronize_streams(ref: DataFrame, sensors: dict[str, DataFrame], trajectory: DataFrame, dt_max: int) -> DataFrame:
    """Reference times whose nearest time of every sensor is less than dt_max away and which lie within the trajectory; renumbered."""
    out = ref.select("scene_id", "us")
    for name, rows in sensors.items():
        near = nearest_timestamp(ref, rows).where(F.col("dt") < dt_max)
        out = out.join(near.select("scene_id", "us", F.col("match").alias(name)), ["scene_id", "us"])
    span = trajectory.groupBy("scene_id").agg(F.min("us").alias("__a"), F.max("us").alias("__b"))
    out = out.join(span, "scene_id").where("us between __a and __b").drop("__a", "__b")
    return numbered(out).withColumn("name", F.lpad(F.col("frame_id").cast("string"), 6, "0"))


def ambiguous_sync_report(near: DataFrame, least_margin: int = 1000) -> DataFrame:
    """Matches that aren't exact or whose second candidate is as near but for least_margin."""
    return near.withColumns({"ambiguous": F.coalesce(F.col("margin") < least_margin, F.lit(False)), "inexact": F.col("dt") > 0}).where("ambiguous or inexact")


def bracket_pose(times: DataFrame, trajectory: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """scene_id, us, prev, next: the trajectory rows (structs) at or before, and at or after, each time."""
    found = beside(times.select("scene_id", "us").distinct(), trajectory, (False, False), bucket)
    return found.withColumnsRenamed({"b": "prev", "a": "next"})


def _quaternion(r: Column) -> list[Column]:
    angle = F.sqrt(r["rx"] ** 2 + r["ry"] ** 2 + r["rz"] ** 2)
    k = F.when(angle == 0, 0.5).otherwise(F.sin(angle / 2) / F.when(angle == 0, 1.0).otherwise(angle))
    return [F.cos(angle / 2), r["rx"] * k, r["ry"] * k, r["rz"] * k]


def interpolate_pose(brackets: DataFrame) -> DataFrame:
    """scene_id, us, tx, ty, tz, qw, qx, qy, qz: straight translation and spherical rotation between the two neighbours."""
    rows = brackets.where("prev is not null and next is not null")
    span = F.col("next")["us"] - F.col("prev")["us"]
    part = F.when(span == 0, 0.0).otherwise((F.col("us") - F.col("prev")["us"]) / F.nullif(span, F.lit(0).cast("long")))
    a, b = _quaternion(F.col("prev")), _quaternion(F.col("next"))
    rows = rows.withColumns({"__p": part, "__a": F.array(*a), "__b": F.array(*b)})
    a, b = [[F.col(c)[i] for i in range(4)] for c in ("__a", "__b")]
    dot = a[0] * b[0] + a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    rows = rows.withColumn("__d", dot)
    sign = F.when(F.col("__d") < 0, -1.0).otherwise(1.0)
    angle = F.acos(F.least(F.lit(1.0), F.abs("__d")))
    flat = F.sin(angle) < 1e-9
    safe = F.when(flat, 1.0).otherwise(F.sin(angle))
    wa = F.when(flat, 1 - F.col("__p")).otherwise(F.sin((1 - F.col("__p")) * angle) / safe)
    wb = F.when(flat, F.col("__p")).otherwise(F.sin(F.col("__p") * angle) / safe) * sign
    out = {f"t{c}": F.col("prev")[f"t{c}"] + F.col("__p") * (F.col("next")[f"t{c}"] - F.col("prev")[f"t{c}"]) for c in "xyz"}
    out |= {f"q{c}": wa * a[i] + wb * b[i] for i, c in enumerate("wxyz")}
    return rows.withColumns(out).select("scene_id", "us", *out)


def pose_matrices(trajectory: DataFrame) -> DataFrame:
    """trajectory with r: the nine values of the rotation."""
    return trajectory.withColumn("r", F.array(*rotvec_to_matrix(F.col("rx"), F.col("ry"), F.col("rz"))))


