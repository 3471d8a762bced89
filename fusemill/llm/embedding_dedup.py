"""Near-duplicate vectors by lattice hashing: random projections decoded to E8 points, neighbouring cells probed, cosine verified.

Vectors are scaled to length one; equal ones are a class, and only classes are
compared.

1. In each of TABLES tables a vector is projected at random to LATTICES blocks
   of eight values, and each block is decoded to its nearest point of E8 (the
   better one of D8 and D8 moved by a half). These points are the vector's base
   cell. It also probes the PROBES next cells: the products of each block's
   neighbours among the 240 shortest vectors of the lattice, by their distance.
   Two vectors meet where the base cell of one is a base or probed cell of the
   other. At a cosine of 0.95 a table misses a pair with probability 0.17, all
   six with 3e-5; nearer pairs are missed far less.
2. Rows of a cell are compared by sketches of 128 signs first, and only rows
   with a plausible partner get their vectors: at 0.95 a pair differs in 13 of
   128 signs on average, and more than MOST_SIGNS are left with probability
   1e-7.
3. Pairs that stay are verified in double precision. A pair that meets in
   several cells counts in the first one only; each task can tell from the two
   vectors which cell that is. A task returns each class's number of linked
   vectors and a forest of its links, never its pairs.

A cell with more rows than a block is cut into parts, and each task gets two of
them, so no cell is one task's work; the work within a crowd of different near
copies still grows with the square of its size.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing and are components of their own; vectors of
different lengths aren't compared; repeated rows are vectors of their own that
link with each other; rows with a null id link with nothing, have a null
component and aren't kept; other columns are ignored, whatever their names; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import dealt, ship, table, written
from fusemill.llm.jaccard_join import components

THRESHOLD = 0.95
TABLES, LATTICES, PROBES = 6, 2, 12
#: Length that a unit vector's projection to eight values has on average, in units of the lattice.
SCALE = 1.3
#: Neighbours of a block's point that are combined with the other blocks' ones.
NEAR = 8
MOST_SIGNS = 32
#: Rows of a cell that a task compares with as many others: sketches, vectors.
SKETCH_BLOCK, BLOCK = 2048, 1024
#: Pairs that are in memory at once.
PAIRS = 1 << 16
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@functools.cache
def roots() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    found = []
    for i, j in itertools.combinations(range(8), 2):
        for a, b in itertools.product((1, -1), repeat=2):
            found.append([a if k == i else b if k == j else 0 for k in range(8)])
    found += [v for v in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(found, float)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer values of even sum: where the rounded sum is odd, the value that is least sure is rounded the other way."""
    near = np.rint(x)
    off = x - near
    odd = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[odd]).argmax(1)
    near[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1))[:, None], whole, half)


@functools.cache
def _projection(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The projections of all tables, their shifts, and the directions of the sketch."""
    rng = np.random.default_rng([20_240_611, dim])
    return rng.normal(size=(dim, TABLES * LATTICES * 8)) * SCALE / 8**0.5, rng.uniform(0, 2, TABLES * LATTICES * 8), rng.normal(size=(dim, 128))


def sketches(unit: np.ndarray) -> np.ndarray:
    """n x 2 words: the signs of 128 random projections."""
    return np.packbits(unit @ _projection(unit.shape[1])[2] > 0, axis=1).view(np.uint64)


def _best_products(excess: np.ndarray) -> np.ndarray:
    """Of all ways to take one of each block's neighbours (n x LATTICES x 1 + NEAR squared distances), the 1 + PROBES best: n x 1 + PROBES x LATTICES."""
    ways = np.array(list(itertools.product(range(excess.shape[2]), repeat=excess.shape[1])))
    total = sum(excess[:, b, ways[:, b]] for b in range(excess.shape[1]))
    return ways[np.argsort(total, axis=1, kind="stable")[:, : 1 + PROBES]]


def cells(unit: np.ndarray) -> np.ndarray:
    """n x TABLES x 1 + PROBES hashes: the base cell, then the probed ones."""
    n, dim = unit.shape
    turn, shift, _ = _projection(dim)
    x = (unit @ turn + shift).reshape(-1, 8)
    near = nearest_e8(x)
    excess = 2 - 2 * (x - near) @ roots().T
    order = np.argpartition(excess, NEAR, axis=1)[:, :NEAR]
    order = np.take_along_axis(order, np.argsort(np.take_along_axis(excess, order, 1), axis=1, kind="stable"), 1)
    points = np.concatenate([near[:, None, :], near[:, None, :] + roots()[order]], 1)
    gaps = np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(excess, order, 1)], 1)
    twice = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    block = np.zeros(twice.shape[:2], np.uint64)
    for k in range(8):
        block = _mix(block * _M + twice[:, :, k] + np.uint64(1))
    block, gaps = block.reshape(n * TABLES, LATTICES, -1), gaps.reshape(n * TABLES, LATTICES, -1)
    ways = _best_products(np.maximum(gaps, 0))
    # the base cell is the way of no step
    at = np.zeros((n * TABLES, 1 + PROBES), np.uint64)
    rows = np.arange(n * TABLES)[:, None]
    for b in range(LATTICES):
        at = _mix(at * _M + block[rows, b, ways[:, :, b]])
    at = at.reshape(n, TABLES, -1) + np.arange(TABLES, dtype=np.uint64)[None, :, None] * _M
    return _mix(_mix(at) + np.uint64(dim))


def units(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and unit vectors of the rows that hold a vector, for each length."""
    rows = column.to_pylist() if column.null_count or (column.flatten().null_count) else None
    if rows is None:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        sizes = np.diff(column.offsets.to_numpy())
        start = np.cumsum(sizes) - sizes
        by = {int(d): np.flatnonzero(sizes == d) for d in np.unique(sizes)}
        held = {d: (at, flat[start[at][:, None] + np.arange(d)]) for d, at in by.items() if d}
    else:
        by = {}
        for k, v in enumerate(rows):
            if v and None not in v:
                by.setdefault(len(v), []).append(k)
        held = {d: (np.array(at), np.array([rows[k] for k in at], float)) for d, at in by.items()}
    found = []
    for at, x in held.values():
        most = np.abs(x).max(1)
        good = np.isfinite(x).all(1) & (most > 0)
        x = x[good] / most[good][:, None]
        found.append((at[good], x / np.sqrt((x * x).sum(1))[:, None] + 0.0))
    return found


def _runs(key: np.ndarray) -> np.ndarray:
    """Where the run of each row of a sorted key ends."""
    cut = np.flatnonzero(np.diff(key)) + 1
    return np.repeat(np.append(cut, len(key)), np.diff(np.concatenate([[0], cut, [len(key)]])))


def meetings(key: np.ndarray, base: np.ndarray, part: np.ndarray, i: int, j: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows that meet in a cell, at least one of them by its base, a bounded number at once."""
    if i == j:
        order = np.lexsort((~base, key))
        end = _runs(key[order])
        own = np.flatnonzero(base[order])
        first, count = own + 1, end[own] - own - 1
        jobs = [(order, own, first, count)]
    else:
        l, r = np.flatnonzero(part == i), np.flatnonzero(part == j)
        r = r[np.argsort(~base[r], kind="stable")]
        order, n_base = np.concatenate([l, r]), int(base[r].sum())
        own = np.arange(len(l))
        jobs = [(order, own, np.full(len(l), len(l)), np.where(base[l], len(r), n_base))]
    for order, own, first, count in jobs:
        done, upto = 0, np.cumsum(count)
        while done < len(own):
            last = max(done + 1, int(np.searchsorted(upto, (upto[done - 1] if done else 0) + PAIRS, "right")))
            c = count[done:last]
            a = np.repeat(own[done:last], c)
            b = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[done:last], c)
            yield order[a], order[b]
            done = last


def roots_of(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest index of each index's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all() and (root[a] == root[b]).all():
            return root
        root = new


def _plausible(t: pa.Table) -> pa.Table:
    """The rows (key, node, base) with a partner whose sketch is near enough."""
    key, node, base, part, s0, s1 = (t[c].to_numpy() for c in ("key", "node", "base", "part", "s0", "s1"))
    s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
    hit = np.zeros(len(key), bool)
    for a, b in meetings(key, base, part, t["i"][0].as_py(), t["j"][0].as_py()):
        near = np.bitwise_count(s0[a] ^ s0[b]).astype(np.int16) + np.bitwise_count(s1[a] ^ s1[b]) <= MOST_SIGNS
        hit[a[near]] = True
        hit[b[near]] = True
    return pa.table({"key": key[hit], "node": node[hit], "base": base[hit]})


def _verified(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        key, node, base, part, copies = (t[c].to_numpy() for c in ("key", "node", "base", "part", "copies"))
        one, at = np.unique(node, return_index=True)
        row = np.searchsorted(one, node)
        links, found = np.zeros(len(one), np.int64), []
        for where, unit in units(t["embedding"].take(pa.array(at)).combine_chunks()):
            place = np.full(len(one), -1)
            place[where] = np.arange(len(where))
            sketch, cell = sketches(unit), cells(unit)
            own = np.flatnonzero(place[row] >= 0)
            p = place[row[own]]
            for a, b in meetings(key[own], base[own], part[own], t["i"][0].as_py(), t["j"][0].as_py()):
                here, x, y = key[own[a]], p[a], p[b]
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1) <= MOST_SIGNS
                here, x, y = here[near], x[near], y[near]
                near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                here, x, y = here[near], np.minimum(x[near], y[near]), np.maximum(x[near], y[near])
                first = np.zeros(len(x), np.uint64)
                for k in range(TABLES - 1, -1, -1):
                    u, v = cell[x, k, 0], cell[y, k, 0]
                    by_u = (cell[y, k] == u[:, None]).any(1)
                    by_v = (cell[x, k] == v[:, None]).any(1)
                    first = np.where(by_u, u, np.where(by_v, v, first))
                new = first == here.view(np.uint64)
                x, y = where[x[new]], where[y[new]]
                np.add.at(links, x, copies[at[y]])
                np.add.at(links, y, copies[at[x]])
                root = roots_of(x, y, len(one))
                tied = np.flatnonzero(root != np.arange(len(one)))
                found.append((tied, root[tied]))
        some = np.flatnonzero(links)
        tied = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
        to = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
        if len(tied):
            root = roots_of(tied, to, len(one))
            tied = np.flatnonzero(root != np.arange(len(one)))
            to = root[tied]
        a, b = np.concatenate([one[tied], one[some]]), np.concatenate([one[to], one[some]])
        return pa.table({"a": a.astype(np.int64), "b": b.astype(np.int64), "n": np.concatenate([np.zeros(len(tied), np.int64), links[some]])})

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, 2000):
            batch = whole.slice(k, 2000)
            digest: list[bytes | None] = [None] * batch.num_rows
            for at, unit in units(batch["embedding"]):
                for i, row in zip(at.tolist(), unit):
                    digest[i] = xxhash.xxh3_128_digest(row.tobytes())
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["embedding"], pa.array(digest, pa.binary())], ["vec_id", "embedding", "digest"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, node, base, s0, s1: each node's base cells and probed ones."""
    for whole in batches:
        for k in range(0, whole.num_rows, 500):
            batch = whole.slice(k, 500)
            for at, unit in units(batch["embedding"]):
                key, sketch, each = cells(unit).view(np.int64), sketches(unit).view(np.int64), TABLES * (1 + PROBES)
                base = np.tile(np.arange(1 + PROBES) == 0, len(at) * TABLES)
                node = batch["node"].to_numpy()[at]
                columns = [key.ravel(), np.repeat(node, each), base, np.repeat(sketch[:, 0], each), np.repeat(sketch[:, 1], each)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "node", "base", "s0", "s1"])


def _shared(rows: DataFrame) -> DataFrame:
    """rows whose cell holds a base and another row, with n, the cell's number of rows."""
    cells_ = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if("base").alias("__b")).where("n > 1 and __b > 0")
    return rows.join(cells_.select("key", "n").hint("merge"), "key")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding: an array of float or double)."""
    ship(vectors.sparkSession)
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    marked = own.mapInArrow(_digests, "vec_id long, embedding array<double>, digest binary")
    marked = marked.withColumn("digest", F.when(F.col("vec_id").isNotNull(), F.col("digest")))
    rows = written(marked.withColumn("row", F.monotonically_increasing_id()), "lattice-vectors")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    classes = written(classes, "lattice-classes")
    one = written(rows.select(F.col("row").alias("node"), "embedding").join(classes.select("node", "copies").hint("merge"), "node"), "lattice-nodes")

    placed = written(one.select("node", "embedding").mapInArrow(_placed, "key long, node long, base boolean, s0 long, s1 long"), "lattice-cells")
    tasks = dealt(written(_shared(placed), "lattice-shared"), "key", "node", SKETCH_BLOCK)
    alive = tasks.groupBy("g", "i", "j").applyInArrow(_plausible, "key long, node long, base boolean").distinct()
    tasks = dealt(written(_shared(written(alive, "lattice-alive")), "lattice-pairs"), "key", "node", BLOCK)
    full = tasks.join(one.hint("merge"), "node").select("g", "i", "j", "part", "key", "node", "base", "copies", "embedding")
    found = written(full.groupBy("g", "i", "j").applyInArrow(_verified(threshold), "a long, b long, n long"), "lattice-links")

    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    joined = components(found.where("a <> b").select("a", "b"), "lattice-components")
    least = joined.join(classes.select("node", "rep"), "node").groupBy("comp").agg(F.min("rep").alias("least"))
    per_class = classes.join(counts, "node", "left").join(joined.join(least, "comp").select("node", "least"), "node", "left")
    per_class = per_class.select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    # written, so that the rows of a large class may be split
    out = rows.select("vec_id", "digest").join(written(per_class, "lattice-per-class").hint("merge"), "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = f"""
with recursive v as (
  select vec_id, embedding::double[] as e from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach as (select vec_id, vec_id as root from embeddings union select l.b, r.root from reach r join links l on l.a = r.vec_id where r.root < l.b)
select e.vec_id, coalesce(any_value(n), 0)::bigint as n_links, min(root) as component_id, e.vec_id = min(root) as kept
from embeddings e join reach r on r.vec_id = e.vec_id left join (select a, count(*) as n from links group by all) k on k.a = e.vec_id group by e.vec_id
"""
