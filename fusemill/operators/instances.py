"""Instances on points and pixels: ranking, overlap, painting, depth order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fusemill.sources.files import stored

#: Words of a vertex block's bitmap.
WORDS = 16
#: Pairs of bitmaps that cost about as much as one pair of masks at one vertex.
PAIR = 4


def _best(value: str | Column, order: Column) -> Column:
    return F.max_by(value, order)


def argmax_label(scores: DataFrame, keys: list[str], threshold: float = 0.7, unknown: int = -1) -> DataFrame:
    """keys, label, score: the best class, first in order on ties; unknown below the threshold or where class 0 scores 0."""
    g = scores.groupBy(*keys).agg(
        F.max(F.struct("score", (-F.col("class_idx")).alias("c"))).alias("b"), F.max(F.when(F.col("class_idx") == 0, F.col("score"))).alias("zero")
    )
    bad = (F.col("b.score") < threshold) | (F.col("zero") == 0)
    return g.select(*keys, F.when(bad, unknown).otherwise(-F.col("b.c")).alias("label"), F.col("b.score").alias("score"))


def topk(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The k first rows of each group, with rank from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def rank_instances(inst: DataFrame) -> DataFrame:
    """scene_id, inst_id, score, class_idx, idx: dense index by falling score."""
    one = inst.select("scene_id", "inst_id", "score", "class_idx").distinct()
    return one.withColumn("idx", F.row_number().over(Window.partitionBy("scene_id").orderBy(F.desc("score"), "inst_id")) - 1)


def vertex_bitmaps(masks: DataFrame, words: int = WORDS) -> DataFrame:
    """scene_id, idx, block and the words of a bitmap: which of a block's vertices (64 a word, vertex_id from 0) a mask holds."""
    at = F.col("vertex_id").cast("long")
    size = 64 * words
    bit = F.expr(f"shiftleft(1L, cast(pmod(cast(vertex_id as bigint), 64) as int))")
    rows = masks.select("scene_id", "idx", F.floor(at / size).alias("block"), F.floor(F.pmod(at, F.lit(size)) / 64).alias("word"), bit.alias("bit"))
    each = [F.coalesce(F.bit_or(F.when(F.col("word") == k, F.col("bit"))), F.lit(0).cast("long")).alias(f"w{k}") for k in range(words)]
    return rows.groupBy("scene_id", "idx", "block").agg(*each)


def mask_overlaps(masks: DataFrame, words: int = WORDS) -> DataFrame:
    """scene_id, i, j, n: shared vertices of each two masks of a scene, itself included; masks: scene_id, idx, vertex_id.

    In a block of vertices whose vertices lie in many masks, masks meet by blocks: two bitmaps are one AND and one count of
    bits a word. In a block of many masks that share few vertices they meet by vertices. The cheaper way is taken for each
    block by its exact numbers of pairs, so thin masks don't pay for the square of a block's masks, nor dense ones for the
    square of a vertex's.
    """
    size = 64 * words
    rows = masks.select("scene_id", "idx", "vertex_id", F.floor(F.col("vertex_id").cast("long") / size).alias("block")).distinct()
    met = rows.groupBy("scene_id", "block", "vertex_id").agg(F.count("*").cast("double").alias("d"))
    by_vertex = met.groupBy("scene_id", "block").agg(F.sum(F.col("d") * F.col("d")).alias("by_vertex"))
    by_block = rows.groupBy("scene_id", "block", "idx").agg(F.lit(1)).groupBy("scene_id", "block").agg(F.count("*").cast("double").alias("m"))
    thin = by_vertex.join(by_block, ["scene_id", "block"]).select("scene_id", "block", (PAIR * F.col("by_vertex") <= F.col("m") * F.col("m")).alias("thin"))
    rows = stored(rows.join(thin, ["scene_id", "block"]), "masks")

    maps = vertex_bitmaps(rows.where("not thin"), words)
    names = [f"w{k}" for k in range(words)]
    a, b = maps.withColumnRenamed("idx", "i"), maps.withColumnsRenamed({"idx": "j"} | {w: f"o{w}" for w in names})
    shared = sum((F.bit_count(F.col(w).bitwiseAND(F.col(f"o{w}"))) for w in names), F.lit(0)).cast("long")
    dense = a.join(b.hint("merge"), ["scene_id", "block"]).select("scene_id", "i", "j", shared.alias("n")).where("n > 0")
    one = rows.where("thin").select("scene_id", F.col("idx").alias("i"), "vertex_id")
    few = one.join(one.withColumnRenamed("i", "j").hint("merge"), ["scene_id", "vertex_id"]).select("scene_id", "i", "j", F.lit(1).cast("long").alias("n"))
    return dense.unionByName(few).groupBy("scene_id", "i", "j").agg(F.sum("n").alias("n"))


def suppress_overlaps(inst: DataFrame, threshold: float, least_score: float = 0.1) -> DataFrame:
    """scene_id, inst_id, idx, class_idx, score of masks that are the first of all that overlap them by more than threshold.

    An overlap counts relative to the largest overlap of the other mask; a
    suppressed mask suppresses as well.
    """
    ranked = rank_instances(inst.where(F.col("score") >= least_score))
    masks = inst.join(ranked.select("scene_id", "inst_id", "idx"), ["scene_id", "inst_id"]).select("scene_id", "idx", "vertex_id").distinct()
    over = mask_overlaps(masks).withColumn("norm", F.col("n") / F.max("n").over(Window.partitionBy("scene_id", "j")))
    first = over.where(F.col("norm") > threshold).groupBy("scene_id", F.col("i").alias("idx")).agg(F.min("j").alias("first"))
    kept = ranked.join(first, ["scene_id", "idx"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("idx")))
    return kept.select("scene_id", "inst_id", "idx", "class_idx", "score")


def paint_last_wins(inst: DataFrame, ranked: DataFrame) -> DataFrame:
    """scene_id, vertex_id, class_idx: of a vertex's instances the one last in rank."""
    rows = inst.select("scene_id", "inst_id", "vertex_id").join(ranked.select("scene_id", "inst_id", "idx", "class_idx"), ["scene_id", "inst_id"])
    return rows.groupBy("scene_id", "vertex_id").agg(F.max_by("class_idx", "idx").alias("class_idx"))


def paint_first_wins(inst: DataFrame) -> DataFrame:
    """scene_id, vertex_id, class_idx: the most confident instance, the lower id on ties."""
    return inst.groupBy("scene_id", "vertex_id").agg(F.max_by("class_idx", F.struct("score", (-F.col("inst_id")).alias("i"))).alias("class_idx"))


def smallest_mask_wins(masks: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label: of a pixel's masks (mask_id, class_idx) the one with the smallest area; 0 without one."""
    frame = [k for k in keys if k not in ("px", "py")]
    area = masks.groupBy(*frame, "mask_id").agg(F.count("*").alias("area"))
    best = masks.join(area, [*frame, "mask_id"]).groupBy(*keys).agg(F.min_by("class_idx", F.struct("area", "mask_id")).alias("label"))
    return grid.select(*keys).join(best, keys, "left").withColumn("label", F.coalesce("label", F.lit(0)))


def zbuffer_fold(hits: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """keys, inst_idx, t: hits in order of instance; one replaces the pixel's if that is farther by more than tolerance."""
    ordered = F.array_sort(F.collect_list(F.struct("inst_idx", "t")))
    start = F.struct(F.lit(-1).alias("i"), F.lit(float("inf")).alias("t"))
    fold = F.aggregate(
        ordered,
        start,
        lambda a, h: F.when(a["t"] > h["t"] + tolerance, F.struct(h["inst_idx"].alias("i"), h["t"].alias("t"))).otherwise(a),
    )
    return hits.groupBy(*keys).agg(fold.alias("f")).select(*keys, F.col("f.i").alias("inst_idx"), F.col("f.t").alias("t"))


def mask_quality(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, quality: score times the mean probability inside the mask (logit above 0)."""
    inside = F.when(F.col("logit") > 0, 1 / (1 + F.exp(-F.col("logit")))).otherwise(0.0)
    n = F.sum(F.when(F.col("logit") > 0, 1.0).otherwise(0.0))
    return rows.groupBy(*by).agg((F.max("score") * F.sum(inside) / (n + 1e-6)).alias("quality"))
