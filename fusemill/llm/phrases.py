"""Collocations by partitioning (SON): phrases that are frequent in a shard by its share of the corpus, then exact counts of all of them.

Texts are lower-cased in A-Z, cut into pieces at ``.,;:!?`` and line ends, and
pieces into words at spaces and tabs. Each language is a corpus of its own.

1. The input's partitions are dealt to SHARDS shards. A shard that holds the share
   w of a language's bytes is mined completely for what occurs ``w * MIN_COUNT``
   times in it: a phrase with MIN_COUNT occurrences reaches that in one shard at
   least, however documents are dealt, so none is lost. A shard grows with the
   input, so many tasks mine it: each counts its texts in slices of SLICE_BYTES,
   and Spark sums the counts by shard. That is done for words, for pairs of
   words, and for three to five words; phrases are looked for only where all of
   their words, and all of their pairs, have been found before.
2. What is frequent in some shard is united as hashes; those whose sum over all
   shards is too small are left out, and the rest is kept in a Bloom filter of 16 MB
   at most that goes to all tasks; each counts the phrases in the filter slice by slice,
   sums the counts of its slices, and Spark sums those of the tasks by phrase. What a filter lets through by chance is
   counted exactly as well, so filters never decide a result.
3. Cuts of a candidate meet the counts of both parts in joins; scores are exact
   decimals. A candidate falls if one with a word more at either end occurs as
   often: counts never grow with length, so longer ones need no look.

Defined results: null and empty texts have no words; a null language is ``und``;
repeated rows count as often as they stand there, whatever their id; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fusemill.llm.common import discard, in_batches, in_some, ship, table, written

LONGEST = 5
MIN_COUNT = 100
TOP = 2000
SHARDS = 4
#: Text that a task counts at once, and rows that it hands over at once.
SLICE_BYTES, ROWS = 4 << 20, 100_000
#: Text that a task is handed at once; what Spark takes by itself (10,000 rows) is many times a slice where texts are long, and is held by the JVM and by Python.
BATCH_BYTES = 1 << 20
#: Phrases that a task of the counting pass sums over its slices before it hands them over.
HELD = 500_000
#: Bits of a bitmap for each candidate, probes of it, and the most bits (as a power of two) that it ever has.
SPARE, HASHES, MOST_BITS = 16, 4, 27
_M = np.uint64(0x9E3779B97F4A7C15)
#: A-Z in lower case, tabs as spaces, the marks that end a piece as line feeds.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 32 if c == 9 else 10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else c for c in range(256))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M
    return h ^ (h >> np.uint64(29))


def words_of(text: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, the number of each occurrence's word, and the piece it stands in."""
    at = np.frombuffer(text.translate(_PLAIN), np.uint8)
    ends_piece = at == 10
    inside = (at != 32) & ~ends_piece
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32)
    start, end = edge[::2], edge[1::2]
    piece = np.searchsorted(np.flatnonzero(ends_piece).astype(np.int32), start).astype(np.int32)
    offsets = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=offsets[1:])
    found = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(at[inside])]).dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy(), piece


def levels(words: list[bytes], code: np.ndarray, piece: np.ndarray, seed: int, keep: Callable[[int, np.ndarray, np.ndarray], np.ndarray], longest: int = LONGEST):
    """k, first places, hashes and counts of the phrases of k words for each k, of which keep(k, counts, hashes) says which stay.

    A phrase is looked for only where its two phrases of k - 1 words stay.
    """
    word_hash = _mix(np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words)))
    start, one, count = np.arange(len(code), dtype=np.int32), code, np.bincount(code, minlength=len(words))
    hashes, first = word_hash, np.zeros(len(words), np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    for k in range(1, longest + 1):
        stay = keep(k, count, hashes)
        rows = np.flatnonzero(stay)
        yield k, first[rows], hashes[rows], count[rows]
        if k == longest:
            return
        # places where a phrase that stays begins, and its number among those
        number = np.cumsum(stay) - 1
        here = stay[one]
        start, one = start[here], number[one[here]]
        hashes = hashes[rows]
        follows = np.flatnonzero((np.diff(start) == 1) & (piece[start[:-1]] == piece[np.minimum(start[:-1] + k, len(piece) - 1)]) & (start[:-1] + k < len(piece)))
        if not len(follows):
            return
        start, prefix = start[follows], one[follows].astype(np.int64)
        key = prefix * len(words) + code[start + k]
        found, at, one, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        first = start[at].astype(np.int64)
        hashes = _mix(hashes[found // len(words)] * _M + word_hash[found % len(words)])


def _slices(batches: Iterator[pa.RecordBatch], slice_bytes: int) -> Iterator[tuple[str, list[bytes]]]:
    """Each language's texts of slices of some slice_bytes."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary())):
            if text.is_valid:
                text = text.as_py()
                held.setdefault(lang, []).append(text)
                size += len(text)
                if size >= slice_bytes:
                    yield from held.items()
                    held, size = {}, 0
    yield from held.items()


def _seed(lang: str) -> int:
    return xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))


def _known(bitmap) -> Callable[[np.ndarray], np.ndarray]:
    """Whether hashes are in a Bloom filter."""
    bits = np.frombuffer(bitmap.value, np.uint64)
    size = np.uint64(len(bits) * 64 - 1)

    def test(h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for k in range(HASHES):
            at = (h >> np.uint64(9 * k)) & size
            found &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    return test


def _mined(low: int, high: int, bitmap, shards: int, slice_bytes: int):
    """lang and bytes of each shard (g), and counts of its phrases of low to high words (lang null) whose phrases of fewer words are in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        known = _known(bitmap) if bitmap else None
        for lang, texts in _slices(batches, slice_bytes):
            words, code, piece = words_of(b"\n".join(texts))
            seed, size = _seed(lang), sum(map(len, texts))
            g = int(np.uint64((seed + shard * int(_M)) % (1 << 64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([g]), pa.array([0]), pa.array([size])], ["lang", "g", "h", "n"])
            if not len(code):
                continue
            keep = lambda k, n, h: known(h) if k < low else np.ones(len(n), bool)
            for k, _, hashes, counts in levels(words, code, piece, seed, keep, high):
                for at in range(0, len(hashes) if k >= low else 0, ROWS):
                    h, n = hashes[at : at + ROWS].view(np.int64), counts[at : at + ROWS].astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.string()), pa.array(np.full(len(n), g)), pa.array(h), pa.array(n)], ["lang", "g", "h", "n"])

    return run


def _counted(bitmap, slice_bytes: int, longest: int, most: int = HELD):
    """Counts of the phrases in the bitmap, and of all words (k = 0, an empty phrase): once a task for each, or more often where a task has over most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known(bitmap)
        held: list[pa.RecordBatch] = []
        rows = summed = 0
        for lang, texts in _slices(batches, slice_bytes):
            words, code, piece = words_of(b"\n".join(texts))
            if not len(code):
                continue
            held.append(_batch(lang, 0, pa.array([b""]), np.array([len(code)])))
            vocabulary = pa.array(words, pa.binary())
            for k, first, _, counts in levels(words, code, piece, _seed(lang), lambda k, n, h: known(h), longest):
                for at in range(0, len(first), ROWS):
                    places = [vocabulary.take(pa.array(code[first[at : at + ROWS] + o])) for o in range(k)]
                    held.append(_batch(lang, k, pc.binary_join_element_wise(*places, b" "), counts[at : at + ROWS]))
                rows += len(first)
            # summed again once they have doubled
            if rows >= max(ROWS, 2 * summed):
                held = _summed(held)
                rows = summed = sum(b.num_rows for b in held)
                if rows >= most:
                    yield from held
                    held, rows, summed = [], 0, 0
        yield from _summed(held)

    return run


def _summed(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """One row for each lang, k and phrase."""
    if not batches:
        return []
    sums = pa.Table.from_batches(batches).group_by(["lang", "k", "phrase"], use_threads=False).aggregate([("n", "sum")])
    return sums.select(["lang", "k", "phrase", "n_sum"]).rename_columns(["lang", "k", "phrase", "n"]).to_batches(max_chunksize=ROWS)


def _batch(lang: str, k: int, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    n = len(phrases)
    columns = [pa.array([lang] * n, pa.string()), pa.array(np.full(n, k, np.int32)), phrases.cast(pa.string()), pa.array(counts.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "k", "phrase", "n"])


def _bitmap(hashes: DataFrame, most_bits: int) -> bytes:
    """A Bloom filter of the h: SPARE bits for each, but never more than 2 ** most_bits; its words come to the driver, at most one for 64 bits."""
    bits = min(max(10, (SPARE * hashes.count()).bit_length()), most_bits)
    at = F.explode(F.array(*(F.shiftrightunsigned("h", 9 * k).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(HASHES)))).alias("at")
    rows = hashes.select(at).groupBy(F.shiftright("at", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros((1 << bits) // 64, np.int64)
    out[rows["id"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def locally_frequent(docs: DataFrame, low: int, high: int, found: DataFrame | None, least: int, shards: int = SHARDS, slice_bytes: int = SLICE_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """h: hashes of the phrases of low to high words that are frequent in a shard by its share and may reach least over all shards; found: those of fewer words."""
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(found, most_bits)) if found is not None else None
    counts = docs.mapInArrow(_mined(low, high, bitmap, shards, slice_bytes), "lang string, g long, h long, n long").groupBy("lang", "g", "h").agg(F.sum("n").alias("n"))
    with in_batches(docs.sparkSession, BATCH_BYTES):
        counts = written(counts, "phrase-shards")
    # one row for each language and shard, by which its phrases are judged
    sizes = counts.where("lang is not null").select("lang", "g", F.col("n").alias("size"))
    whole = sizes.groupBy("lang").agg(F.sum("size").alias("whole"))
    # a language of empty texts has no phrases
    share = F.expr(f"({least} * size + whole - 1) div greatest(whole, 1)")
    local = written(sizes.join(whole, "lang").select("g", F.greatest(share, F.lit(1)).alias("local")), "phrase-supports")
    phrases = counts.where("lang is null")
    frequent = written(phrases.join(local, "g").where(F.col("n") >= F.col("local")).select("h").distinct(), "phrase-frequent")
    # hashes may stand for several phrases, so a sum over the shards is no less than a phrase's count
    whole = phrases.where(in_some(frequent)(F.col("h"))).groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    out = written(whole.select("h"), "phrase-candidates")
    discard(counts, frequent)
    return out


def frequent_phrases(docs: DataFrame, least: int = MIN_COUNT, longest: int = LONGEST, shards: int = SHARDS, slice_bytes: int = SLICE_BYTES, most_bits: int = MOST_BITS) -> DataFrame:
    """lang, k, phrase, n: exact counts of all phrases of 1 to longest words that occur least times in a language, and of all its words (k = 0)."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found: list[DataFrame] = []
    for low, high in ((1, 1), (2, 2), (3, longest)):
        before = reduce(DataFrame.unionByName, found) if found else None
        found.append(locally_frequent(own, low, high, before, least, shards, slice_bytes, most_bits))
    bitmap = spark.sparkContext.broadcast(_bitmap(reduce(DataFrame.unionByName, found), most_bits))
    discard(*found)
    # a phrase is handed over once a task, so tasks are as many as cores ask for, not as the input has partitions
    own = own.coalesce(2 * spark.sparkContext.defaultParallelism)
    counted = own.mapInArrow(_counted(bitmap, slice_bytes, longest), "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    with in_batches(spark, BATCH_BYTES):
        return written(counted.where((F.col("n") >= least) | (F.col("k") == 0)), "phrase-counts")


def collocations(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of the candidates (counts: as of frequent_phrases) that no longer one makes superfluous, by their lowest cut."""
    total = counts.where("k = 0").select("lang", F.col("n").alias("total"))
    several = counts.where("k > 1").select("lang", "k", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    part = lambda first, size: F.array_join(F.slice("words", first, size), " ")
    inner = several.where("k > 2").select("lang", F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1))).alias("phrase"), "a").distinct()
    kept = several.join(inner, ["lang", "phrase", "a"], "left_anti")
    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    known = lambda name, n: counts.where("k > 0").select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    cuts = cuts.join(known("first", "l"), ["lang", "first"]).join(known("rest", "r"), ["lang", "rest"]).join(total, "lang")

    def wide(c: str, digits: int) -> str:
        return f"cast({c} as decimal({digits}, 0))"

    score = F.expr(f"({wide('1000', 4)} * {wide('a', 15)} * {wide('total', 17)}) div ({wide('l', 17)} * {wide('r', 17)})")
    low = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"), F.max("a").alias("a"), F.max("total").alias("n"))
    return low.select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def top(found: DataFrame, n: int = TOP) -> DataFrame:
    """The first n of each language, with rank from 1; tasks keep n rows a language before they are shuffled."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return found.withColumn("rank", place).where(F.col("rank") <= n).withColumn("rank", F.col("rank").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(collocations(frequent_phrases(table(spark, sf_dir, "documents")))).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = f"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents
), w as (select lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda x: x <> '') as w from pieces),
starts as (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, (select unnest(range(1, {LONGEST + 1})) as k) where len(w) >= k),
f as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f from starts group by all),
n as (select lang, sum(f)::hugeint as n from f where k = 1 group by lang),
cand as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k > 1 and f >= {MIN_COUNT}),
inner_ as (select c.lang, c.a, array_to_string(c.w[i:i + j - 1], ' ') as phrase from cand c, (select unnest(range(2, {LONGEST})) as j) x, (select unnest(range(1, {LONGEST})) as i) y where j < c.k and i + j - 1 <= c.k),
kept as (select * from cand c where not exists (select 1 from inner_ i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)),
cuts as (select lang, phrase, a, cut, array_to_string(w[1:cut], ' ') as first_, array_to_string(w[cut + 1:], ' ') as rest from kept, (select unnest(range(1, {LONGEST})) as cut) where cut < k),
scored as (select c.*, l.f as l, r.f as r, n.n, ((1000::hugeint * a * n.n) // (l.f::hugeint * r.f))::bigint as score
  from cuts c join f l on l.lang = c.lang and l.phrase = first_ join f r on r.lang = c.lang and r.phrase = rest join n on n.lang = c.lang),
low as (select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n::bigint as n, score from low
qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= {TOP}
"""
