"""Depth: fits of a predicted depth to a sensor's, and completion of holes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fit_affine_depth(rows: DataFrame) -> DataFrame:
    """rows (mono, depth_mm) with fitted: each frame's least squares over its measured pixels, rounded to six decimals and cut to an integer.

    The rounding comes first: a fit that meets an integer may miss it by a last bit, either way by the order of summation.
    """
    frame = ["scene_id", "frame_id"]
    seen = rows.where("depth_mm <> 0").groupBy(*frame).agg(F.regr_slope("depth_mm", "mono").alias("a"), F.regr_intercept("depth_mm", "mono").alias("b"))
    return rows.join(seen, frame, "left").withColumn("fitted", F.round(F.col("a") * F.col("mono") + F.col("b"), 6).try_cast("int")).drop("a", "b")


def complete_depth(rows: DataFrame, patch: int = 32) -> DataFrame:
    """rows with completed: a missing depth is fitted over the patch around it by window sums, first along rows, then along columns.

    Slopes below 0.5 or above 2 fall back to the prediction, as does a patch
    without a measurement; a result that isn't positive does too. Frames with
    missing pixels are filled up for the window sums alone.
    """
    span = rows.groupBy("scene_id", "frame_id").agg(F.count("*").alias("__n"), *(f(c).alias(f"__{k}{c}") for c in ("px", "py") for k, f in (("a", F.min), ("b", F.max))))
    gaps = span.where("__n < (__bpx - __apx + 1) * (__bpy - __apy + 1)").select("*", F.explode(F.sequence("__apx", "__bpx")).alias("px"))
    gaps = gaps.select("scene_id", "frame_id", "px", F.explode(F.sequence("__apy", "__bpy")).alias("py")).join(rows, ["scene_id", "frame_id", "px", "py"], "left_anti")
    rows = rows.withColumn("__real", F.lit(True)).unionByName(gaps, allowMissingColumns=True)
    seen = F.coalesce(F.col("depth_mm") != 0, F.lit(False))
    x, y = F.col("mono").cast("double"), F.col("depth_mm").cast("double")
    terms = {"n": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y, "sxx": x * x}
    across = Window.partitionBy("scene_id", "frame_id", "py").orderBy("px").rangeBetween(-patch, patch - 1)
    down = Window.partitionBy("scene_id", "frame_id", "px").orderBy("py").rangeBetween(-patch, patch - 1)
    out = rows.withColumns({k: F.sum(F.when(seen, v).otherwise(0.0)).over(across) for k, v in terms.items()})
    out = out.withColumns({k: F.sum(k).over(down) for k in terms})
    n, sx, sy, sxy, sxx = (F.col(k) for k in terms)
    det = n * sxx - sx * sx
    # all x equal: the solution of least norm
    mean_x, mean_y = F.try_divide(sx, n), F.try_divide(sy, n)
    a = F.when(n == 0, 0.0).when(det <= 1e-9 * n * sxx, mean_x * mean_y / (mean_x * mean_x + 1)).otherwise(F.try_divide(n * sxy - sx * sy, det))
    b = F.when(n == 0, 0.0).when(det <= 1e-9 * n * sxx, mean_y / (mean_x * mean_x + 1)).otherwise(F.try_divide(sy * sxx - sx * sxy, det))
    out = out.withColumns({"a": a, "b": b})
    fitted = F.when((F.col("a") < 0.5) | (F.col("a") > 2), x).otherwise(F.col("a") * x + F.col("b"))
    whole: Column = F.greatest(fitted.try_cast("int"), F.lit(0))
    done = F.when(seen, F.col("depth_mm")).otherwise(F.when(whole == 0, F.col("mono")).otherwise(whole))
    return out.withColumn("completed", done).where("__real").drop(*terms, "a", "b", "__real")
