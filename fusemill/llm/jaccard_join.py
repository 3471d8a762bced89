"""N-gram Jaccard self-join with Bayesian pruning of candidates.

Words are the text's white-space separated words in lower case; a document's set
holds the hashes of its runs of ``n`` words (of all its words, if it has fewer).
Documents with equal sets are one class and only its first document is compared.

1. MinHash signatures of the classes give band keys. In each bucket of a key the
   classes are paired with the smallest one, and pairs whose signatures can't
   reach the threshold (by the rule of step 2) are dropped; what is dropped forms
   the next round's bucket of that key, so no bucket is ever expanded into its
   pairs and no pair is lost. What still stands after ROUNDS rounds is linked
   unverified. The components of these links, found by alternating large and
   small stars, hold every pair that can be similar; classes that merely share a
   band fall apart.
2. A component is cut into blocks. A task gets the texts of two blocks and
   compares their pairs: it counts equal MinHash values bit by bit in growing
   prefixes and drops a pair once the posterior probability of reaching the
   threshold (uniform prior) is below ``tolerance``. Pairs that stay are verified
   exactly, with set intersections as products of 0/1 matrices.
3. A task returns, for each class, the number of documents it is linked to, and
   a spanning forest of its links; the forests' components are the groups.

The 32 bands of 4 values miss a pair of similarity 0.8 with probability 5e-8.

Defined results: null, empty and wordless texts have no set, are linked to
nothing and are groups of their own; repeated rows are documents of equal text;
rows with a null id are left out; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import WordHashes, in_some, ship, table, texts_of, written

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 4
STEP = 16
TOLERANCE = 1e-9
BLOCK = 256
ROUNDS = 4
_RNG = np.random.default_rng(20_240_607)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
_M = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingles(words: np.ndarray, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the runs of n word hashes."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = _mix(h * _M + words[k : len(words) - n + 1 + k] + np.uint64(1))
    return np.unique(h)


def sets_of(texts: list[str], known: WordHashes, n: int = N) -> list[np.ndarray]:
    return [shingles(known.of(t.lower().split()), n) for t in texts]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, a row for each (non-empty) set."""
    flat = _mix(np.concatenate(sets)).astype(np.uint32)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    at = np.cumsum(size) - size
    out = np.empty((len(sets), len(_A)), np.uint32)
    for k in range(len(_A)):
        x = flat * _A[k] + _B[k]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x85EBCA6B)
        out[:, k] = np.minimum.reduceat(x, at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        h = _mix(h * _M + sig[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return _mix(h + np.arange(BANDS, dtype=np.uint64) * _M)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE, step: int = STEP) -> dict[int, int]:
    """For each prefix length: the fewest equal values with P(similarity >= threshold | equal) >= tolerance under a uniform prior."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    found = {}
    for n in range(step, len(_A) + 1, step):
        for m in range(n + 1):
            like = m * np.log(grid) + (n - m) * np.log1p(-grid)
            like = np.exp(like - like.max())
            if like[grid >= threshold].sum() / like.sum() >= tolerance:
                found[n] = m
                break
    return found


def linked(left: list[np.ndarray], right: list[np.ndarray], ls: np.ndarray, rs: np.ndarray, least: dict[int, int], threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of sets whose similarity reaches the threshold."""
    alive = np.ones((len(left), len(right)), bool)
    if same:
        alive = np.triu(alive, 1)
    a, b = np.nonzero(alive)
    done = 0
    hits = np.zeros(len(a), np.int16)
    for n, m in least.items():
        hits += (ls[a, done:n] == rs[b, done:n]).sum(1, dtype=np.int16)
        stay = hits >= m
        a, b, hits, done = a[stay], b[stay], hits[stay], n
    if not len(a):
        return a, b
    la, ra = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    fits = np.minimum(la[a], ra[b]) >= threshold * np.maximum(la[a], ra[b]) - 1e-9
    a, b = a[fits], b[fits]
    if len(a) > 8 * (len(set(a.tolist())) + len(set(b.tolist()))):
        both = _products(left, right, a, b)
    else:
        both = np.array([len(np.intersect1d(left[i], right[j], assume_unique=True)) for i, j in zip(a, b)], np.int64)
    ok = both >= threshold * (la[a] + ra[b] - both) - 1e-9
    return a[ok], b[ok]


def _products(left: list[np.ndarray], right: list[np.ndarray], a: np.ndarray, b: np.ndarray, width: int = 8192) -> np.ndarray:
    """Intersection sizes of many pairs: 0/1 matrices over slices of the shared vocabulary."""
    ls, rs = np.concatenate(left), np.concatenate(right)
    vocabulary = np.intersect1d(ls, rs)
    lo, ro = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    lk, rk = np.searchsorted(vocabulary, ls), np.searchsorted(vocabulary, rs)
    lin = np.append(vocabulary, 0)[lk] == ls if len(vocabulary) else np.zeros(len(ls), bool)
    rin = np.append(vocabulary, 0)[rk] == rs if len(vocabulary) else np.zeros(len(rs), bool)
    lin &= lk < len(vocabulary)
    rin &= rk < len(vocabulary)
    total = np.zeros((len(left), len(right)))
    for k in range(0, len(vocabulary), width):
        x, y = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        i, j = lin & (lk >= k) & (lk < k + width), rin & (rk >= k) & (rk < k + width)
        x[lo[i], lk[i] - k], y[ro[j], rk[j] - k] = 1, 1
        total += x @ y.T
    return total[a, b].astype(np.int64)


def components(edges: DataFrame, name: str) -> DataFrame:
    """node, comp: the smallest node of each node's component, by alternating large and small stars; edges: a, b (long)."""
    spark = edges.sparkSession
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    last = None
    while True:
        # large star: every larger neighbour of a node is tied to the node's smallest neighbour
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node's smaller neighbours and itself are tied to its smallest neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, name)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return now.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        last = tuple(state)


def digests(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id, digest, keys, sig: equal digests mean equal sets; documents without words are left out. keys: the band keys; sig: the signature's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                sets = sets_of(texts_of(batch["text"]), known, n)
                some = [i for i, s in enumerate(sets) if len(s)]
                if not some:
                    continue
                sets = [sets[i] for i in some]
                sig = signatures(sets)
                keys = band_keys(sig).view(np.int64)
                two = [(int(s.sum(dtype=np.uint64)) << 64 | int(np.bitwise_xor.reduce(_mix(s)))).to_bytes(16, "little") + len(s).to_bytes(4, "little") for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["doc_id"].take(pa.array(some)),
                        pa.array(two, pa.binary()),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel())),
                        pa.array([row.tobytes() for row in sig], pa.binary()),
                    ],
                    ["doc_id", "digest", "keys", "sig"],
                )

    return docs.mapInArrow(run, "doc_id long, digest binary, keys array<long>, sig binary")


def plausible(pairs: DataFrame, sigs: DataFrame, least: dict[int, int]) -> DataFrame:
    """The pairs (a, b) whose signatures (doc_id, sig) agree in enough of each prefix."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(batch.num_rows, -1) for c in ("x", "y"))
            stay, hits, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, m in least.items():
                hits = hits + (x[stay, done:n] == y[stay, done:n]).sum(1)
                stay, hits, done = stay[hits >= m], hits[hits >= m], n
            yield pa.RecordBatch.from_arrays([batch["a"].take(pa.array(stay)), batch["b"].take(pa.array(stay))], ["a", "b"])

    side = lambda id_, sig: sigs.select(F.col("doc_id").alias(id_), F.col("sig").alias(sig)).hint("merge")
    return pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def star_links(buckets: DataFrame, sigs: DataFrame, least: dict[int, int], rounds: int = ROUNDS) -> DataFrame:
    """a, b: links that connect, in each bucket (key, doc_id), all that may be similar."""
    live, found = buckets, None
    for turn in range(rounds + 1):
        heads = written(live.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("key", "a"), "join-heads")
        # merge joins at every size: what is moved then grows in proportion to the input
        rows = written(live.join(heads.hint("merge"), "key").select("key", "a", F.col("doc_id").alias("b")).where("a <> b"), "join-stars")
        pairs = rows.select("a", "b").distinct()
        if turn < rounds:
            pairs = written(plausible(pairs, sigs, least), "join-plausible")
        found = pairs if found is None else found.unionByName(pairs)
        if turn == rounds:
            return found
        live = written(rows.join(pairs.hint("merge"), ["a", "b"], "left_anti").select("key", F.col("b").alias("doc_id")), "join-live")
        if live.isEmpty():
            return found


def similar_groups(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id (smallest id of its group) and n_links (documents whose similarity reaches the threshold)."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    marked = written(digests(own, n), "join-digests")
    # written, so that the join with a large class may be split
    classes = written(marked.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "join-classes")
    members = written(marked.select("doc_id", "digest").join(classes.hint("merge"), "digest").select("doc_id", "rep", "copies"), "join-members")
    reps = members.where("doc_id = rep").groupBy("rep").agg(F.max("copies").alias("copies"))
    compared = written(marked.join(reps.select(F.col("rep").alias("doc_id")), "doc_id").select("doc_id", "keys", "sig"), "join-reps")
    buckets = written(compared.select("doc_id", F.explode("keys").alias("key")), "join-buckets")
    least = least_matches(threshold, tolerance)
    near = components(star_links(buckets, compared.select("doc_id", "sig"), least), "join-near")
    sized = near.join(near.groupBy("comp").agg(F.count("*").alias("size")), "comp").join(reps, near.node == reps.rep).select("node", "comp", "size", "copies")
    # Small components share a task; a large one is cut into blocks, and each task gets two of them.
    spread = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / block)).cast("int")
    sized = written(sized.withColumn("part", F.when(F.col("size") > block, spread).otherwise(-1)), "join-sized")
    n_small = sized.where("part < 0").count()
    groups = max(1, n_small // (2 * block))
    cuts = F.ceil(F.col("size") / block).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), cuts - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j")))
    alone = F.array(F.struct(F.pmod(F.xxhash64("comp"), F.lit(groups)).cast("int").alias("i"), F.lit(-1).alias("j")))
    tasks = sized.select("node", "comp", "copies", "part", F.explode(F.when(F.col("part") < 0, alone).otherwise(pairs)).alias("t"))
    tasks = tasks.select("node", "comp", "copies", "part", F.when(F.col("part") < 0, F.lit(-1).cast("long")).otherwise(F.col("comp")).alias("g"), "t.i", "t.j")
    wanted = in_some(sized.select(F.xxhash64("node").alias("h")))(F.xxhash64("doc_id"))
    with_text = tasks.join(own.where(wanted).withColumnRenamed("doc_id", "node").hint("merge"), "node")

    def compare(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.unique(t["node"].to_numpy(), return_index=True)[1]))  # repeated rows
        node, comp, copies, part = (t[c].to_numpy() for c in ("node", "comp", "copies", "part"))
        sets = sets_of(texts_of(t["text"]), WordHashes(), n)
        sig = signatures(sets)
        links = np.zeros(len(node), np.int64)
        root = list(range(len(node)))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        forest = []

        def take(l: np.ndarray, r: np.ndarray, same: bool) -> None:
            a, b = linked([sets[i] for i in l], [sets[i] for i in r], sig[l], sig[r], least, threshold, same)
            a, b = l[a], r[b]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            for x, y in zip(a.tolist(), b.tolist()):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
                    forest.append((node[x], node[y], 0))

        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        if j < 0:
            order = np.argsort(comp, kind="stable")
            for own_rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
                take(own_rows, own_rows, True)
        elif i == j:
            take(np.arange(len(node)), np.arange(len(node)), True)
        else:
            take(np.flatnonzero(part == i), np.flatnonzero(part == j), False)
        some = np.flatnonzero(links)
        a, b, c = zip(*forest, *((node[k], node[k], links[k]) for k in some)) if len(some) else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(c, pa.int64())})

    found = written(with_text.groupBy("g", "i", "j").applyInArrow(compare, "a long, b long, n long"), "join-links")
    counts = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("others"))
    joined = components(found.where("a <> b").select("a", "b"), "join-groups").select(F.col("node").alias("rep"), "comp")
    per_class = reps.join(counts, "rep", "left").join(joined, "rep", "left")
    per_class = per_class.select("rep", F.coalesce("comp", "rep").alias("class_id"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    # written as well, so that the rows of a large class may be split
    known = members.select("doc_id", "rep").join(written(per_class, "join-per-class").hint("merge"), "rep")
    rest = own.select("doc_id").join(members.select("doc_id"), "doc_id", "left_anti")
    return known.select("doc_id", "class_id", "n_links").unionByName(rest.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(table(spark, sf_dir, "documents"))


ORACLE_SQL = f"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as words from documents where doc_id is not null
), sets as (
  select distinct doc_id, array_to_string(list_slice(words, i, i + least({N}, len(words)) - 1), ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - least({N}, len(words)) + 2)) as i from w where len(words) > 0)
), sizes as (select doc_id, count(*) as n from sets group by all),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
links as (select a, b from both_ join sizes x on x.doc_id = a join sizes y on y.doc_id = b where c >= {THRESHOLD} * (x.n + y.n - c) - 1e-9),
reach as (select doc_id, doc_id as root from w union select l.b, r.root from reach r join links l on l.a = r.doc_id where r.root < l.b)
select w.doc_id, min(root) as class_id, coalesce(any_value(n), 0)::bigint as n_links
from w join reach using (doc_id) left join (select a as doc_id, count(*) as n from links group by all) k using (doc_id) group by w.doc_id
"""
