"""Removal of repeated byte strings by sampled grams, ranked at two lengths.

A suffix array's prefix doubling ranks every position by ever longer prefixes,
from pairs of ranks, and positions whose rank is unique leave. Here only strings
of ``length`` bytes matter, and moving every position would be 25 GB a round on
half a gigabyte of Parquet. So this is gram sampling in place of doubling: of the
grams of half the length, each window of ``length`` bytes is stood for by its
least gram (by hash, the leftmost of equal ones); equal windows have the same
gram at the same place in them, so comparing the windows of equal grams compares
all equal windows. Ranks are hashes of the bytes themselves at three quarters of
the length and at the whole of it, and what is unique leaves after each.

1. Rows of equal texts are one text, whose id is the smallest of theirs; in the
   rows of larger ids every byte of a long enough text is removed.
2. Three quarters: the sampled gram with the bytes that follow it, and with those
   that precede it, are its first ranks. Texts are dealt to slices; a slice hands
   its distinct ranks over by leading bits and is answered, by one bit each, which
   of them two texts hold. For these it gives a row: the gram, its place and the
   bytes of its windows on both sides. From here on Spark sorts and groups rows:
   those that agree in all of these are one class with the smallest id, and a row
   of a larger id is covered.
3. The classes are ranked by three quarters again; ranks of one id leave.
4. The whole length: each window of what is left is a row (class, place in the
   window), ranked by its gram and the bytes around it. A window whose rank has
   a smaller id is covered.
5. The covered windows go back to the positions of their classes and to the
   texts, whose covered bytes are cut out.

What is left after each rank is told by joins and by the answers, so rows stay in
proportion to what is repeated. The maps of fixed size that remain leave out rows
early before such a join and never decide a result; where they fill up, the join
takes the rest. Every grouping by rank is a partial aggregate and every return a
join that Spark may split, so a frequent gram is not one task's work.
A gram, a class and a window are told apart by 64-bit hashes.

Defined results: null and empty texts have no bytes; texts shorter than
``length`` lose nothing; rows that repeat an id and text are one document; texts
of one id don't remove each other; rows with a null id are returned whole and
remove nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import discard, in_some, ship, table, written

LENGTH = 50
#: A bucket of grams has at most three leading bits less than this in common.
MAP_BITS = 27
#: Bits of the maps that Spark's expressions read.
RANK_BITS, TEXT_BITS = 24, 22
#: Text bytes for a bucket of grams, and for a slice of texts.
BUCKET_BYTES, SLICE_BYTES = 3 << 20, 8 << 20
#: Bytes that a task looks at together.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_M = np.uint64(0xBF58476D1CE4E5B9)
POSITION = pa.schema([("first", pa.int64()), ("text", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("hi", pa.int32()), ("lo", pa.int32()), ("near", pa.binary())])
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Grams:
    """Hashes of the k bytes from each position on, for any k, by sums over prefixes."""

    def __init__(self, data: np.ndarray):
        power, self.back = np.full(len(data), _BASE), np.full(len(data), _INVERSE)
        power[0] = self.back[0] = 1
        np.multiply.accumulate(power, out=power)
        np.multiply.accumulate(self.back, out=self.back)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=self.total[1:])

    def all(self, k: int) -> np.ndarray:
        return _mix((self.total[k:] - self.total[:-k]) * self.back[: len(self.total) - k])

    def at(self, place: np.ndarray, k: int) -> np.ndarray:
        return _mix((self.total[place + k] - self.total[place]) * self.back[place])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each run of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == w else np.minimum(x[: len(x) - (w - size)], x[w - size :])


class Sample:
    """Sampled positions (at), their grams' hashes (h), and how many bytes before each its first (hi) and last (lo) window begin.

    after and before: the ranks of three quarters of the length, where some window holds these bytes.
    """

    def __init__(self, data: np.ndarray, valid: np.ndarray, length: int):
        k = length // 2
        side = length - k
        half = side // 2 + 1
        grams = Grams(data)
        h = grams.all(k)
        # one word orders by hash, then by place
        least = _sliding_min((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), side + 1)
        window = np.flatnonzero(valid)
        at = (least[window] & _PLACE).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])[: len(at)])
        last = np.append(cut[1:], len(at)) - 1 if len(at) else cut
        self.at, self.h = at[cut], h[at[cut]]
        self.hi, self.lo = self.at - window[cut], self.at - window[last]
        self.has_after, self.has_before = self.lo <= side - half, self.hi >= half
        self.after, self.before = np.zeros_like(self.h), np.zeros_like(self.h)
        self.after[self.has_after] = grams.at(self.at[self.has_after], k + half)
        self.before[self.has_before] = _mix(grams.at(self.at[self.has_before] - half, k + half) + _M)


def pieces(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes of several texts (a long text in overlapping parts): bytes, valid windows, and each byte's text and offset."""
    group, size = [], 0

    def out():
        data = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        sizes = np.array([len(g[2]) for g in group])
        owner = np.repeat([g[0] for g in group], sizes)
        starts = np.cumsum(sizes) - sizes
        offset = np.arange(len(data)) - np.repeat(starts, sizes) + np.repeat([g[1] for g in group], sizes)
        left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
        return data, left[: len(data) - length + 1] >= length, owner, offset

    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[a : a + PIECE + length - 1]
            if len(part) >= length:
                group.append((k, a, part))
                size += len(part)
            if size >= PIECE:
                yield out()
                group, size = [], 0
    if group:
        yield out()


def _by_bucket(h: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Runs of sorted hashes with equal leading bits."""
    if bits == 0:
        yield 0, slice(0, len(h))
        return
    top = (h >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(top, prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(h))):
        yield int(top[a]), slice(a, b)


def _planes(h: np.ndarray) -> bytes:
    """Sorted hashes as differences of their upper 48 bits, byte plane by byte plane, which compresses well."""
    h = h >> np.uint64(16)
    return np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _unplaned(body: bytes) -> np.ndarray:
    cells = np.zeros((len(body) // 6, 8), np.uint8)
    cells[:, :6] = np.frombuffer(body, np.uint8).reshape(6, -1).T
    return np.cumsum(cells.reshape(-1).view(np.uint64)) << np.uint64(16)


def _bits(n: float, most: int) -> int:
    return min(most, max(0, int(np.ceil(np.log2(max(1, n))))))


def _ranks(x: Sample, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ranks of three quarters of the length in a piece, and the texts that hold them."""
    return np.concatenate([x.after[x.has_after], x.before[x.has_before]]), np.concatenate([owner[x.at[x.has_after]], owner[x.at[x.has_before]]])


def _in_order(slice_: pa.Table) -> pa.Table:
    """A slice's texts in an order that doesn't depend on how its rows came."""
    return slice_.sort_by([("first", "ascending"), ("text", "ascending")])


def repeated_grams(sliced: DataFrame, length: int, bits: int) -> DataFrame:
    """slice, bucket, bits: of a slice's distinct ranks of three quarters of the length, in order, which of them two texts hold.

    sliced: slice, first, text, data (binary). A bucket answers each slice about the
    slice's own ranks with leading bits bits equal to the bucket, so what is held at
    once and what is handed on stay in proportion to the texts.
    """

    def ranks(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slice_ = _in_order(pa.Table.from_batches(batches))
        found = [(h, of.astype(np.uint64)) for data, valid, owner, _ in pieces(slice_["data"].to_pylist(), length) for h, of in [_ranks(Sample(data, valid, length), owner)]]
        h, of = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(h)
        h, of = h[order], of[order]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
        if not len(start):
            return
        many = np.minimum.reduceat(of, start) != np.maximum.reduceat(of, start)
        h = h[start]
        found = [(bucket, _planes(h[s]), np.packbits(many[s]).tobytes()) for bucket, s in _by_bucket(h, bits)]
        bucket, grams, shared = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(found), pa.int64()), pa.array(bucket, pa.int64()), pa.array(grams, pa.binary()), pa.array(shared, pa.binary())], ["slice", "bucket", "grams", "many"])

    def repeated(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices, grams, many = [], [], []
        for batch in batches:
            slices += batch["slice"].to_pylist()
            for g, m in zip(batch["grams"].to_pylist(), batch["many"].to_pylist()):
                grams.append(_unplaned(g))
                many.append(np.unpackbits(np.frombuffer(m, np.uint8), count=len(grams[-1])) == 1)
        sizes = [len(g) for g in grams]
        g, shared = np.concatenate(grams), np.concatenate(many)
        order = np.argsort(g)
        same = g[order[1:]] == g[order[:-1]]
        shared[order[1:][same]] = shared[order[:-1][same]] = True
        answers = [np.packbits(x).tobytes() for x in np.split(shared, np.cumsum(sizes)[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array([key[0].as_py()] * len(slices), pa.int64()), pa.array(sizes, pa.int32()), pa.array(answers, pa.binary())], ["slice", "bucket", "n", "bits"])

    found = sliced.groupBy("slice").applyInArrow(ranks, "slice long, bucket long, grams binary, many binary")
    return found.groupBy("bucket").applyInArrow(repeated, "slice long, bucket long, n int, bits binary")


def positions(sliced: DataFrame, answers: DataFrame, length: int) -> DataFrame:
    """A row for each sampled position of which a rank is repeated.

    first, text (of sliced), h (gram), at (offset), hi and lo (its windows begin hi
    to lo bytes before it), near (the bytes of these windows without the gram).
    """
    k = length // 2
    side = length - k
    half = side // 2 + 1

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        slice_ = _in_order(left)
        first, text = slice_["first"].to_numpy(), slice_["text"].to_numpy()
        right = right.sort_by("bucket")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) == 1 for n, b in zip(right["n"].to_pylist(), right["bits"].to_pylist())]
        parts = [(Sample(data, valid, length), data, owner, offset) for data, valid, owner, offset in pieces(slice_["data"].to_pylist(), length)]
        known = np.unique(np.concatenate([_ranks(x, owner)[0] for x, _, owner, _ in parts])) if parts else np.zeros(0, np.uint64)
        known = known[np.concatenate(flags)] if flags else known
        out = []
        for x, data, owner, offset in parts:
            after, before = x.has_after & np.isin(x.after, known), x.has_before & np.isin(x.before, known)
            # windows of a half whose rank is unique leave
            lo, hi = np.where(after, x.lo, np.maximum(x.lo, side - half + 1)), np.where(before, x.hi, np.minimum(x.hi, side - half))
            some = after | before
            at, h, hi, lo = x.at[some], x.h[some], hi[some], lo[some]
            reach = np.concatenate([np.arange(-side, 0), np.arange(k, k + side)])
            inside = np.concatenate([np.arange(side, 0, -1) <= hi[:, None], np.arange(1, side + 1) <= side - lo[:, None]], 1)
            near = data[np.clip(at[:, None] + reach, 0, len(data) - 1)][inside]
            ends = np.concatenate([[0], np.cumsum(hi + side - lo)]).astype(np.int32)
            bytes_ = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(near.tobytes())])
            columns = [pa.array(first[owner[at]]), pa.array(text[owner[at]]), pa.array(h.view(np.int64)), pa.array(offset[at].astype(np.int32)), pa.array(hi.astype(np.int32)), pa.array(lo.astype(np.int32)), bytes_]
            out.append(pa.RecordBatch.from_arrays(columns, POSITION.names))
        return pa.Table.from_batches(out, POSITION)

    return sliced.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(run, "first long, text long, h long, at int, hi int, lo int, near binary")


def covered_windows(rows: DataFrame, length: int) -> DataFrame:
    """text, first, at, mask: bit o is set where the window that begins o bytes before at is also in a text of a smaller id."""
    side = length - length // 2
    half = side // 2 + 1
    class_id = F.xxhash64("h", "hi", "near")
    classes = rows.groupBy("h", "hi", "lo", "near").agg(F.min("first").alias("first"), F.max("first").alias("last"))
    classes = written(classes.withColumn("id", class_id), "repeat-classes", compression="zstd")
    # three quarters: the gram with what follows, and with what precedes
    after, before = F.expr(f"substring(near, hi + 1, {half})"), F.expr(f"substring(near, hi - {half} + 1, {half})")
    longer = {"after": (F.col("lo") <= side - half, F.xxhash64("h", F.lit(1), after)), "before": (F.col("hi") >= half, F.xxhash64("h", F.lit(2), before))}
    either = F.array(*(F.struct(F.lit(k).alias("side"), F.when(has, rank).alias("h")) for k, (has, rank) in enumerate(longer.values(), 1)))
    ranks = classes.select("id", "first", F.explode(either).alias("r")).select("id", "first", "r.side", "r.h").where("h is not null")
    shared = written(ranks.groupBy("h").agg(F.min("first").alias("a"), F.max("first").alias("z")).where("a < z").select("h"), "repeat-shared")
    open_ = ranks.select("id", "side", "h").join(shared.hint("merge"), "h", "left_semi").groupBy("id").agg(F.bit_or("side").alias("open"))
    first_o = F.when(F.col("open").bitwiseAND(1) > 0, F.col("lo")).otherwise(F.greatest("lo", F.lit(side - half + 1)))
    last_o = F.when(F.col("open").bitwiseAND(2) > 0, F.col("hi")).otherwise(F.least("hi", F.lit(side - half)))
    # the whole length: a row for each window
    ranged = classes.join(open_.hint("merge"), "id").select("id", "first", "h", "hi", "near", first_o.alias("a"), last_o.alias("z")).where("a <= z")
    ranged = written(ranged, "repeat-open", compression="zstd")
    discard(shared)
    each = ranged.select("id", "first", F.explode(F.expr("sequence(a, z)")).alias("o"), "h", "hi", "near")
    windows = each.select("id", "first", "o", F.xxhash64("h", "o", F.expr(f"substring(near, hi - o + 1, {side})")).alias("w"))
    least = written(windows.groupBy("w").agg(F.min("first").alias("least"), F.max("first").alias("last")).where("least < last").select("w", "least"), "repeat-ranks")
    hits = windows.where(in_some(least.select(F.col("w").alias("h")), bits=RANK_BITS)(F.col("w"))).join(least.hint("merge"), "w").where("least < first")
    hits = hits.select("id", "first", F.expr("shiftleft(1L, o)").alias("mask"))
    judged = hits.unionByName(classes.where("first < last").select("id", "first", F.lit(0).cast("long").alias("mask")))
    judged = written(judged.groupBy("id").agg(F.min("first").alias("least"), F.bit_or("mask").alias("mask")), "repeat-judged")
    discard(least, ranged, classes)
    back = rows.select("text", "first", "at", "hi", "lo", class_id.alias("id")).where(in_some(judged.select(F.col("id").alias("h")), bits=RANK_BITS)(F.col("id")))
    own = F.expr("shiftleft(2L, hi) - shiftleft(1L, lo)")
    masks = back.join(judged.hint("merge"), "id").select("text", "first", "at", F.when(F.col("first") > F.col("least"), own).otherwise(F.col("mask")).alias("mask"))
    return masks.where("mask <> 0")


def cut_out(rows: DataFrame, length: int, with_kept: bool) -> DataFrame:
    """rows: doc_id, data and covers (structs of at and mask)."""
    side = length - length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            covers = batch["covers"]
            at, mask = (np.asarray(x) for x in covers.flatten().flatten())
            ends = np.concatenate([[0], np.cumsum(covers.value_lengths().to_numpy())])
            for r, (doc_id, data) in enumerate(zip(batch["doc_id"].to_pylist(), batch["data"].to_pylist())):
                a, m = at[ends[r] : ends[r + 1]], mask[ends[r] : ends[r + 1]]
                edge = np.zeros(len(data) + 1, np.int32)
                for o in range(side + 1):
                    begin = a[(m >> o) & 1 == 1] - o
                    np.add.at(edge, begin, 1)
                    np.add.at(edge, begin + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                n_spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                out.append((doc_id, len(data), int(gone.sum()), n_spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_kept else [])))
            if out:
                kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * with_kept
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(kinds)])

    return rows.mapInArrow(run, RESULT + ", kept binary" * with_kept)


def remove_repeats(docs: DataFrame, length: int = LENGTH, map_bits: int = MAP_BITS, bucket_bytes: int = BUCKET_BYTES, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, kept (binary)."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("data"))
    own = own.withColumns({"sha": F.unhex(F.sha2("data", 256)), "n": F.length("data")})
    marked = written(own.where("doc_id is not null").select("doc_id", "sha", "n"), "repeat-texts")
    texts = written(marked.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("n").alias("n")), "repeat-firsts")
    total = texts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    # one row of each text (and a few more rows, which change nothing: they hold what a smaller id holds)
    known = in_some(texts.select(F.xxhash64("first", "sha").alias("h")), bits=TEXT_BITS)(F.xxhash64("doc_id", "sha"))
    once = own.where((F.col("n") >= length) & F.col("doc_id").isNotNull() & known).select(F.col("doc_id").alias("first"), F.xxhash64("sha").alias("text"), "data")
    sliced = once.withColumn("slice", F.pmod(F.xxhash64("first", "text", F.lit(1)), F.lit(-(-total // SLICE_BYTES) or 1)))
    answers = repeated_grams(sliced, length, _bits(total / bucket_bytes, map_bits - 3))
    rows = written(positions(sliced, answers, length), "repeat-positions", compression="zstd")
    covers = covered_windows(rows, length).groupBy("text", "first").agg(F.collect_list(F.struct("at", "mask")).alias("covers"))
    # rows that the map of texts let through beside a text's first one have none
    covers = written(covers.join(texts.select(F.xxhash64("sha").alias("text"), "first"), ["text", "first"], "left_semi"), "repeat-covers")
    discard(rows)
    keys = covers.select("text", F.col("first").alias("doc_id"))
    base = own.select("doc_id", "sha", "n", F.sha2("data", 256).alias("whole"), *(["data"] if with_kept else []), F.xxhash64("sha").alias("text"))
    base = base.join(texts.select("sha", "first"), "sha", "left")
    copy = (F.col("doc_id") > F.col("first")) & (F.col("n") >= length)
    zero, n = F.lit(0).cast("long"), F.col("n").cast("long")
    plain = base.withColumn("copy", F.coalesce(copy, F.lit(False))).join(keys.withColumn("cut", F.lit(True)), ["text", "doc_id"], "left").where("copy or cut is null")
    plain = plain.select(
        "doc_id",
        n.alias("n_bytes"),
        F.when(F.col("copy"), n).otherwise(zero).alias("n_removed"),
        F.when(F.col("copy"), F.lit(1).cast("long")).otherwise(zero).alias("n_spans"),
        F.when(F.col("copy"), F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("whole")).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("").cast("binary")).otherwise(F.col("data")).alias("kept")] if with_kept else []),
    )
    some = own.withColumn("text", F.xxhash64("sha")).where(in_some(keys.select(F.col("text").alias("h")), bits=TEXT_BITS)(F.col("text")))
    # only the first rows of a text, which are none's copies, have covers
    cut = some.select("text", "doc_id", "data").join(covers.withColumnRenamed("first", "doc_id").hint("merge"), ["text", "doc_id"]).select("doc_id", "data", "covers")
    return plain.unionByName(cut_out(cut, length, with_kept))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_kept=False)
