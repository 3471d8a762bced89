"""Points fused in voxels, scene bounds, class embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def voxel_columns(size: float) -> dict:
    return {f"v{c}": F.floor(F.col(c) / size).cast("long") for c in XYZ}


def voxel_quantize(points: DataFrame, size: float = 0.02) -> DataFrame:
    """scene_id, vertex_id, rep: each point's voxel is represented by its smallest vertex."""
    rows = points.withColumns(voxel_columns(size))
    keys = ["scene_id", "vx", "vy", "vz"]
    return rows.join(rows.groupBy(*keys).agg(F.min("vertex_id").alias("rep")), keys).select("scene_id", "vertex_id", "rep")


def voxel_downsample(points: DataFrame, size: float, values: tuple[str, ...] = ()) -> DataFrame:
    """scene_id, vx, vy, vz, x, y, z, values, n: mean position, and mean of values (such as colours), in each voxel."""
    return points.withColumns(voxel_columns(size)).groupBy("scene_id", "vx", "vy", "vz").agg(*(F.avg(c).alias(c) for c in (*XYZ, *values)), F.count("*").alias("n"))


def tsdf_accumulate(rays: DataFrame, voxel: float, trunc: float, values: tuple[str, ...] = ()) -> DataFrame:
    """scene_id, vx, vy, vz, sdf, values, weight: mean truncated signed distance, and mean of values, of the voxels along each ray near its surface.

    rays: scene_id, camera (ox, oy, oz), surface point x, y, z and values. A ray
    counts once in a voxel, with the distance of the voxel's centre along the ray.
    """
    n = int(trunc / voxel)
    dist = F.sqrt(sum((F.col(c) - F.col(f"o{c}")) ** 2 for c in XYZ))
    away = rays.withColumn("dist", dist).where("dist > 0").withColumns({f"d{c}": (F.col(c) - F.col(f"o{c}")) / F.col("dist") for c in XYZ})

    def cell(step):
        return F.struct(*(F.floor((F.col(c) + F.col(f"d{c}") * (step * voxel)) / voxel).cast("long").alias(f"v{c}") for c in XYZ))

    near = away.withColumn("v", F.explode(F.array_distinct(F.array(*(cell(k) for k in range(-n, n + 1))))))
    along = sum(((F.col(f"v.v{c}") + 0.5) * voxel - F.col(f"o{c}")) * F.col(f"d{c}") for c in XYZ)
    sdf = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("dist") - along) / trunc))  # positive in front of the surface
    return near.withColumn("sdf", sdf).groupBy("scene_id", "v.vx", "v.vy", "v.vz").agg(F.avg("sdf").alias("sdf"), *(F.avg(c).alias(c) for c in values), F.count("*").alias("weight"))


def pose_bounds(poses: DataFrame) -> DataFrame:
    """scene_id, center_x/y/z, scale: of the translations of valid poses."""
    g = poses.groupBy("scene_id").agg(*(F.min(f"t{c}").alias(f"a{c}") for c in XYZ), *(F.max(f"t{c}").alias(f"b{c}") for c in XYZ))
    extent = F.greatest(*(F.col(f"b{c}") - F.col(f"a{c}") for c in XYZ))
    return g.select("scene_id", *(((F.col(f"a{c}") + F.col(f"b{c}")) / 2).alias(f"center_{c}") for c in XYZ), (2.0 / (extent + 3.0)).alias("scale"))


def normalize_scene(poses: DataFrame, bounds: DataFrame) -> DataFrame:
    """poses with translations moved to the bounds' centre and scaled."""
    out = poses.join(bounds, "scene_id")
    return out.withColumns({f"t{c}": (F.col(f"t{c}") - F.col(f"center_{c}")) * F.col("scale") for c in XYZ}).select(*poses.columns, "scale")


def class_embedding(vectors: DataFrame) -> DataFrame:
    """label, pos, value: mean of a class's normalised vectors, normalised again."""
    unit = vectors.withColumn("norm", F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))
    long = unit.select("label", "norm", F.posexplode("embedding").alias("pos", "v"))
    mean = long.groupBy("label", "pos").agg(F.avg(F.try_divide(F.col("v").cast("double"), F.col("norm"))).alias("m"))
    total = mean.groupBy("label").agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("t"))
    return mean.join(total, "label").select("label", "pos", F.try_divide("m", "t").alias("value"))
