"""Confusion counts of a stream of label pairs: counts are mergeable, so a running aggregate is the whole state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.sources.files import finished

COUNTS = ["scene_id", "pred_id", "label_id"]


def running_confmat(pairs: DataFrame) -> DataFrame:
    """scene_id, pred_id, label_id, n of all pairs (scene_id, pred_id, label_id) so far; complete or update mode."""
    return pairs.groupBy("scene_id", "pred_id", "label_id").agg(F.count("*").alias("n"))


def windowed_confmat(pairs: DataFrame, time: str = "ts", length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """The same for each window of event time; a window is closed once the watermark has passed it."""
    counted = pairs.withWatermark(time, late).groupBy(F.window(time, length).alias("w"), "pred_id", "label_id").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "pred_id", "label_id", "n")


def counts_sink(folder: str, by: list[str] = COUNTS) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that adds a batch's pairs to the counts in folder.

    A batch is a folder of its own, named by its id and written over if it comes again, so a batch that is sent
    twice counts once; one that has been merged into a base is left out.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        base = max((n for n, _ in finished(batch.sparkSession, folder, "base")), default=-1)
        if batch_id > base:
            batch.groupBy(*by).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{folder}/batch-{batch_id}")

    return add


def _parts(spark: SparkSession, folder: str) -> tuple[list[str], int]:
    """The newest base and the batches after it, and the id of the last."""
    base = max(finished(spark, folder, "base"), default=(-1, None))
    later = [(n, p) for n, p in finished(spark, folder, "batch") if n > base[0]]
    return [p for _, p in ([base] if base[1] else []) + sorted(later)], max([base[0], *(n for n, _ in later)])


def merged_counts(spark: SparkSession, folder: str, by: list[str] = COUNTS) -> DataFrame:
    """by, n: the sums of all batches so far; at least one must be there."""
    return spark.read.parquet(*_parts(spark, folder)[0]).groupBy(*by).agg(F.sum("n").alias("n"))


def compact_counts(spark: SparkSession, folder: str, by: list[str] = COUNTS) -> None:
    """Sums all batches so far into a base, so that readers open few files; stopped halfway, the batches still count."""
    paths, last = _parts(spark, folder)
    if len(paths) > 1:
        spark.read.parquet(*paths).groupBy(*by).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{folder}/base-{last}")
