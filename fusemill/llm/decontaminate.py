"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits in lower case. Documents and test items
that share runs of ``seed`` words are joined on the runs' hashes. For each such
pair, running Karp-Rabin over the words finds the longest common run that no
tile covers yet: the search length falls from the item's length, at each length
the hashes of unmarked runs are compared, and hits are verified and marked, until
no run of ``seed`` words is left. So passages whose sentences were reordered are
covered as well. A document is contaminated if its tiles cover at least
``coverage`` of an item's words.

Tiles of seed words or more that cover so many words hold coverage / seed of
the item's words as starts of seeds at least; pairs that share fewer can't be
contaminated and are not tiled. Equal texts, and equal items, are judged once.
Items shorter than ``seed`` words are matched as one whole run; items without a
word match nothing. The items' seeds are sent to the tasks, to filter runs, only
while they number at most MAX_BROADCAST; beyond, runs are joined by a shuffle.

Defined results: null and empty texts are clean; documents and items are told
apart by their texts, so null and repeated ids are judged like others (a null
item id marks a document without being listed); ties between equally long runs
go to the one first in the item, then in the document; other columns pass
through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import WordHashes, in_some, ship, table, texts_of, written

SEED = 5
COVERAGE = 0.6
NAMES = ("contaminated", "items", "most")
MAX_BROADCAST = 1_000_000
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def runs(h: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash of each run of n word hashes, rolled by prefix sums."""
    if len(h) < n or n < 1:
        return np.empty(0, np.uint64)
    one = np.ones(1, np.uint64)
    power = np.multiply.accumulate(np.concatenate([one, np.full(len(h) - 1, _BASE)]))
    back = np.multiply.accumulate(np.concatenate([one, np.full(len(h) - n, _INVERSE)]))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * power, dtype=np.uint64)])
    # a run's sum is a multiple of its first word's power, which is divided out
    return (total[n:] - total[:-n]) * back


def _free(used: np.ndarray, n: int) -> np.ndarray:
    """Whether each run of n places is unmarked."""
    marked = np.concatenate([[0], np.cumsum(used)])
    return marked[n:] == marked[:-n]


def _common(item: np.ndarray, doc: np.ndarray, used_i: np.ndarray, used_d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unmarked runs of n words whose hashes both sides have: starts and hashes in the item and in the document, by start."""
    i, d = np.flatnonzero(_free(used_i, n)), np.flatnonzero(_free(used_d, n))
    hi, hd = runs(item, n)[i], runs(doc, n)[d]
    both = np.intersect1d(hi, hd)
    some_i, some_d = np.isin(hi, both), np.isin(hd, both)
    return i[some_i], hi[some_i], d[some_d], hd[some_d]


def tile(item: list[str], doc: list[str], seed: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in document, length): the longest unmarked common runs first.

    The next length is found by bisection, as every part of a common run is one;
    tiles of so many different lengths add up to more than half their number's
    square, so the lengths tried are few for any pair of texts.
    """
    seed = min(seed, len(item))
    if not seed:
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(item), 1)}
    words = np.fromiter((number.get(w, 0) for w in doc), np.int64, len(doc))
    # words that the item lacks match nothing: of each run of them one is left, as a border
    place = np.flatnonzero((words > 0) | np.concatenate([[True], words[:-1] > 0])[: len(words)])
    words = words[place]
    own = np.fromiter((number[w] for w in item), np.int64, len(item))
    hashes = _mixed(own), _mixed(words)
    used_i, used_d = np.zeros(len(own), bool), words == 0
    tiles: list[tuple[int, int, int]] = []
    longest = min(len(own), len(words))
    while longest >= seed:
        low, high, found = seed - 1, longest, None
        while low < high:
            n = (low + high + 1) // 2
            got = _common(*hashes, used_i, used_d, n)
            if len(got[0]):
                low, found = n, got
            else:
                high = n - 1
        if found is None:
            break
        longest = low
        i, hi, d, hd = found
        order = np.argsort(hd, kind="stable")
        d, hd = d[order], hd[order]
        next_d, end_d = np.searchsorted(hd, hi), np.searchsorted(hd, hi, "right")
        turn: dict[int, int] = {}
        for a, h, k, stop in zip(i.tolist(), hi.tolist(), next_d.tolist(), end_d.tolist()):
            k = turn.get(h, k)
            if not used_i[a : a + longest].any():
                while k < stop and used_d[d[k] : d[k] + longest].any():
                    k += 1
                if k < stop and np.array_equal(own[a : a + longest], words[d[k] : d[k] + longest]):
                    used_i[a : a + longest] = used_d[d[k] : d[k] + longest] = True
                    tiles.append((a, int(place[d[k]]), longest))
                turn[h] = k
        longest -= 1
    return tiles


def _mixed(k: np.ndarray) -> np.ndarray:
    h = (k.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def items_of(benchmark: DataFrame) -> DataFrame:
    """item (digest of the text), ids (sorted, without null), text: each text once."""
    rows = benchmark.where("text is not null").select(F.unhex(F.sha2("text", 256)).alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
    return rows.groupBy("item").agg(F.array_sort(F.collect_set("item_id")).alias("ids"), F.min("text").alias("text"))


def item_seeds(items: DataFrame, seed: int) -> DataFrame:
    """n, run, item, times, n_words: how often an item has each run of seed words (or all of a shorter item as one run of n words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for item, text in zip(batch["item"].to_pylist(), texts_of(batch["text"])):
                h = known.of(words_of(text))
                n = min(seed, len(h))
                found, times = np.unique(runs(h, n), return_counts=True)
                out += [(n, r, item, t, len(h)) for r, t in zip(found.view(np.int64).tolist(), times.tolist())]
            if out:
                kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["n", "run", "item", "times", "n_words"])

    return items.select("item", "text").mapInArrow(run, "n int, run long, item binary, times long, n_words long")


def doc_runs(texts: DataFrame, lengths: list[int], only: dict[int, np.ndarray] | None) -> DataFrame:
    """n, run, key: the distinct runs of each text (key, text), those in only where that is given."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                hashes = [known.of(words_of(t)) for t in texts_of(batch["text"])]
                for n in lengths:
                    flat = np.concatenate([runs(h, n) for h in hashes])
                    owner = np.repeat(np.arange(len(hashes)), [max(0, len(h) - n + 1) for h in hashes])
                    if only is not None:
                        some = only[n]
                        at = np.minimum(np.searchsorted(some, flat), len(some) - 1)
                        hit = some[at] == flat
                        flat, owner = flat[hit], owner[hit]
                    if len(flat):
                        both = np.unique(np.stack([flat.view(np.int64), owner], 1), axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(both), n, np.int32)), pa.array(both[:, 0].copy()), batch["key"].take(pa.array(both[:, 1]))], ["n", "run", "key"])

    return texts.mapInArrow(find, "n int, run long, key binary")


def matches(texts: DataFrame, items: DataFrame, seed: int = SEED, coverage: float = 0.0, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """key, item, n_words, covered, n_tiles: every pair of a text (key, text) and an item (item, text) that shares a seed and may be covered so far."""
    spark = texts.sparkSession
    ship(spark)
    seeds = written(item_seeds(items, seed), "item-seeds")
    lengths = [r.n for r in seeds.select("n").distinct().orderBy("n").collect()]
    if not lengths:
        return spark.createDataFrame([], "key binary, item binary, n_words long, covered long, n_tiles long")
    distinct = seeds.select("n", "run").distinct()
    only = None
    if distinct.limit(max_broadcast + 1).count() <= max_broadcast:
        only = {n: np.array([], np.uint64) for n in lengths}
        got = distinct.toPandas()
        only |= {n: np.sort(got.run[got.n == n].to_numpy().view(np.uint64)) for n in lengths}
    shared = doc_runs(texts, lengths, only).join(seeds, ["n", "run"]).groupBy("key", "item").agg(F.sum("times").alias("times"), F.max("n_words").alias("n_words"))
    pairs = written(shared.where(F.col("times") * seed >= F.lit(coverage) * F.col("n_words") - F.lit(1e-9)).select("key", "item"), "item-pairs")
    # the texts of some pair, each once
    wanted = in_some(pairs.select(F.xxhash64("key").alias("h")))(F.xxhash64("key"))
    both = pairs.join(items.select("item", F.col("text").alias("item_text")), "item").join(texts.where(wanted).dropDuplicates(["key"]), "key")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, doc = [], None, []
            for key, item, item_text, text in zip(*(batch[c].to_pylist() for c in ("key", "item", "item_text", "text"))):
                if key != last:
                    last, doc = key, words_of(text)
                test = words_of(item_text)
                tiles = tile(test, doc, seed)
                rows.append((key, item, len(test), sum(x[2] for x in tiles), len(tiles)))
            if rows:
                kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "item", "n_words", "covered", "n_tiles"])

    return both.select("key", "item", "item_text", "text").mapInArrow(judge, "key binary, item binary, n_words long, covered long, n_tiles long")


def contaminated(docs: DataFrame, benchmark: DataFrame, seed: int = SEED, coverage: float = COVERAGE, names: tuple[str, str, str] = NAMES, keep_text: bool = True) -> DataFrame:
    """docs with names: whether a document covers an item, the sorted ids of these items, and the largest share of one's words. Columns of these names are replaced."""
    docs = docs.drop(*names)
    keyed = docs.withColumn("__key", F.unhex(F.sha2("text", 256)))
    items = written(items_of(benchmark), "items")
    found = matches(keyed.where("text is not null").select(F.col("__key").alias("key"), "text"), items, seed, coverage)
    found = found.where((F.col("covered") > 0) & (F.col("covered") >= coverage * F.col("n_words"))).join(items.select("item", "ids"), "item")
    found = found.groupBy(F.col("key").alias("__key")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("__ids"), F.max(F.col("covered") / F.col("n_words")).alias("__most")
    )
    out = (keyed if keep_text else keyed.drop("text")).join(found, "__key", "left")
    none = F.array().cast("array<long>")
    out = out.withColumns({names[0]: F.col("__most").isNotNull(), names[1]: F.coalesce("__ids", none), names[2]: F.coalesce("__most", F.lit(0.0))})
    return out.select(*(c for c in docs.columns if keep_text or c != "text"), *names)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf_dir, "benchmark"), keep_text=False).withColumn("most", F.round("most", 6))
