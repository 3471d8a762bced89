"""Evaluation by confusion counts: sparse, mergeable, null for a label that isn't in the list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fusemill.operators.vocab import targets


def unmatched_confmat(pred: DataFrame, truth: DataFrame, keys: list[str], pred_ids: DataFrame, label_ids: DataFrame, by: list[str] = []) -> DataFrame:
    """by, pred_id, label_id, n: pixel counts; an id outside its list (id) is null.

    Pixels are counted by raw labels first, and the few counts are matched to the lists.
    """
    raw = pred.withColumnRenamed("label", "p").join(truth.withColumnRenamed("label", "t").select(*keys, "t"), keys)
    return listed_confmat(raw.groupBy(*by, "p", "t").agg(F.count("*").alias("n")), pred_ids, label_ids, by)


def listed_confmat(raw: DataFrame, pred_ids: DataFrame, label_ids: DataFrame, by: list[str] = []) -> DataFrame:
    """by, pred_id, label_id, n of counts by raw labels (by, p, t, n); an id outside its list (id) is null."""
    raw = raw.join(pred_ids.select(F.col("id").alias("p"), F.col("id").alias("pred_id")), "p", "left")
    raw = raw.join(label_ids.select(F.col("id").alias("t"), F.col("id").alias("label_id")), "t", "left")
    return raw.groupBy(*by, "pred_id", "label_id").agg(F.sum("n").alias("n"))


def match_confmat(counts: DataFrame, pairs: DataFrame, left_to_right: bool = True, by: list[str] = []) -> DataFrame:
    """by, pred_id, label_id, n in the label space: a miss with several targets counts for each of them."""
    rows = counts.where("label_id is not null")
    to = targets(pairs, True).withColumnRenamed("from_id", "pred_id")
    rows = rows.join(to, "pred_id", "left")
    if not left_to_right:
        mapped = pairs.select(F.col("r").alias("label_id")).distinct().withColumn("__mapped", F.lit(True))
        rows = rows.join(mapped, "label_id", "left").withColumn("targets", F.when(F.col("__mapped"), F.col("targets")))
    hit = F.array_contains("targets", F.col("label_id"))
    none = F.array(F.lit(None).cast("int"))
    to_ids = F.when(F.col("targets").isNull(), none).when(hit, F.array("label_id")).otherwise(F.col("targets"))
    return rows.select(*by, F.explode(to_ids).alias("pred_id"), "label_id", "n").groupBy(*by, "pred_id", "label_id").agg(F.sum("n").alias("n"))


def pixel_confmat(counts: DataFrame, pairs: DataFrame, by: list[str] = []) -> DataFrame:
    """match_confmat without the row of unmatched predictions."""
    return match_confmat(counts, pairs, by=by).where("pred_id is not null")


def class_metrics(matched: DataFrame, by: list[str] = []) -> DataFrame:
    """by, class_id, n_truth, iou, acc of each class with ground truth or predictions; null without ground truth."""
    rows = matched.where("pred_id is not null").groupBy(*by, F.col("pred_id").alias("class_id")).agg(F.sum("n").alias("rows"))
    cols = matched.groupBy(*by, F.col("label_id").alias("class_id")).agg(F.sum("n").alias("cols"), F.sum(F.when(F.col("pred_id") == F.col("label_id"), F.col("n")).otherwise(0)).alias("d"))
    out = rows.join(cols, [*by, "class_id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0))
    iou = F.when(F.col("cols") > 0, zero("d") / (zero("rows") + F.col("cols") - F.col("d")))
    return out.select(*by, "class_id", zero("cols").alias("n_truth"), iou.alias("iou"), F.when(F.col("cols") > 0, F.col("d") / F.col("cols")).alias("acc"))


def segmentation_metrics(matched: DataFrame, by: list[str] = []) -> DataFrame:
    """by, m_iou, m_acc (means over classes with ground truth) and t_acc (share of all counted pixels that agree)."""
    means = class_metrics(matched, by).where("n_truth > 0").groupBy(*by).agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("m_iou"), F.avg(F.coalesce("acc", F.lit(0.0))).alias("m_acc"))
    total = matched.groupBy(*by).agg((F.sum(F.when(F.col("pred_id") == F.col("label_id"), F.col("n")).otherwise(0)) / F.sum("n")).alias("t_acc"))
    return means.join(total, by) if by else means.join(total)


def evaluate_scenes(matched: DataFrame) -> DataFrame:
    """Metrics of the summed counts (scene_id null) and of each scene."""
    whole = matched.groupBy("pred_id", "label_id").agg(F.sum("n").alias("n")).withColumn("scene_id", F.lit(None).cast("int"))
    both = matched.groupBy("scene_id", "pred_id", "label_id").agg(F.sum("n").alias("n")).unionByName(whole)
    keyed = both.withColumn("g", F.coalesce("scene_id", F.lit(-1))).drop("scene_id")
    return segmentation_metrics(keyed, ["g"]).withColumn("scene_id", F.nullif("g", F.lit(-1))).drop("g")


def report_pivot(metrics: DataFrame, methods: list[str]) -> DataFrame:
    """class_id and a column of IoU for each method, classes with ground truth only; metrics: method, class_id, n_truth, iou."""
    return metrics.where("n_truth > 0").groupBy("class_id").pivot("method", methods).agg(F.first("iou"))


def report_methods(metrics: DataFrame, classes: list[int]) -> DataFrame:
    """The report transposed: method, place (best mean IoU first, then by name), m_iou and a column c<id> for each class; metrics as above."""
    truth = metrics.where("n_truth > 0")
    wide = truth.groupBy("method").pivot("class_id", classes).agg(F.first("iou")).withColumnsRenamed({str(c): f"c{c}" for c in classes})
    means = truth.groupBy("method").agg(F.avg(F.coalesce("iou", F.lit(0.0))).alias("m_iou"))
    # one row a method
    place = F.row_number().over(Window.orderBy(F.desc(F.round("m_iou", 9)), "method"))
    return means.join(wide, "method").withColumn("place", place).select("method", "place", "m_iou", *(f"c{c}" for c in classes))


def class_histogram(labels: DataFrame, by: list[str], classes: DataFrame | None = None) -> DataFrame:
    """by, label, n, share; classes (label) without a pixel have zero."""
    n = labels.groupBy(*by, "label").agg(F.count("*").alias("n"))
    if classes is not None:
        grid = n.select(*by).distinct().join(classes.select("label").distinct())
        n = grid.join(n, [*by, "label"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
