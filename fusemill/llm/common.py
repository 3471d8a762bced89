"""Helpers that several text operators share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most entries that a per-worker word cache holds before it is emptied.
CACHE = 250_000
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors' Python workers, once a context."""
    sc = spark.sparkContext
    if not getattr(sc, "_fusemill_shipped", False):
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / "fusemill.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        sc._fusemill_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not where:
        got = sc._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: it is computed once and later readers survive lost executors.

    The table cuts the lineage, so the shuffle files behind it are given up with it.
    """
    path, conf = fresh_dir(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(FREE_SHUFFLES, "false")
    conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        conf.set(FREE_SHUFFLES, before)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._written_at = path
    return back


@contextmanager
def in_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """What is run within hands rows to Python workers in Arrow batches of some size bytes, and one row more at most, whatever the length of texts."""
    conf, before = spark.conf, spark.conf.get(BATCH_BYTES, None)
    conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        conf.unset(BATCH_BYTES) if before is None else conf.set(BATCH_BYTES, before)


def discard(*tables: DataFrame) -> None:
    """Deletes written tables whose readers are written themselves."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(df._written_at)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hash64(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


class WordHashes(dict):
    """Word -> 64-bit hash, remembered up to CACHE words."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = hash64(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, null as the empty text."""
    return ["" if x is None else x for x in column.to_pylist()]


def dealt(rows: DataFrame, key: str, node: str, block: int, small: int = 8192) -> DataFrame:
    """rows (a written table with n, the number of rows of their key) with g, i, j, the task they go to, and part.

    Keys of at most block rows share tasks of some small rows (i = j = -1); a
    larger key is cut into parts of some block rows, and a task gets two of them
    (parts i <= j), so that every two rows of a key meet in a task.
    """
    few = F.col("n") <= block
    groups = max(1, rows.where(few).count() // small)
    cuts = F.ceil(F.col("n") / block).cast("int")
    rows = rows.withColumn("part", F.when(few, -1).otherwise(F.pmod(F.xxhash64(node), cuts).cast("int")))
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    alone = F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))
    tasks = rows.withColumn("__t", F.explode(F.when(few, alone).otherwise(pairs)))
    g = F.when(few, F.pmod(F.xxhash64(key), F.lit(groups)).cast("long")).otherwise(F.col(key))
    return tasks.withColumns({"g": g, "i": F.col("__t.i"), "j": F.col("__t.j")}).drop("__t", "n")


def in_some(keys: DataFrame, bits: int = 22) -> Callable[[Column], Column]:
    """A test that is true for every hash in keys (column h, long) and for few others: a bitmap of 2 ** bits bits, whatever the number of keys.

    It leaves out rows early where an exact join follows; where the map fills up, it leaves out fewer.
    """
    size = 1 << bits
    words = keys.groupBy(F.shiftright(F.pmod("h", F.lit(size)), 6).alias("id")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(h, {size}) & 63 as int))")).alias("bits"))
    whole = keys.sparkSession.range(size // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    bitmap = whole.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap")).scalar()

    def test(h: Column) -> Column:
        here = F.pmod(h, F.lit(size))
        return F.call_function("getbit", F.get(bitmap, F.shiftright(here, 6).cast("int")), here.bitwiseAND(F.lit(63)).cast("int")) == 1

    return test
