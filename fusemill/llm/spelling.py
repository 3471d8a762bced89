"""Spelling variants: words that differ by one letter, found in a bit-sliced index of positions.

1. Tasks count runs of letters and Spark sums the counts; in 1 of 199 runs of a
   document (by a checksum) a letter is left out, which plants misspellings. Words
   of LEAST_LENGTH letters that occur LEAST_COUNT times are the vocabulary.
2. An inserted, deleted or replaced letter leaves one half of a word as it is. So
   each word goes to groups keyed by its length (or the length less one, where it
   may be the longer partner) and its first or last half; every near pair shares
   a group, and just one group of a pair owns it. A group larger than a block is
   cut into parts, of which a task gets two.
3. A task indexes its words: one bitset over all of them for each position and
   letter. All of its words are then read at once, letter by letter: the set of
   words equal so far, and the sets with one letter replaced, one more or one
   less, whose positions are the same, one on or one back, are each an AND with
   the bitset of that position; what leaves the first set by its error enters
   another. At the end the sets are cut to the words of the right length.
4. A task returns for each word the number of its near words and the best one.
   Roots follow forms by doubling; a form is five times as frequent at least, so
   chains are short.

Defined results: null and empty texts have no words; in a row without an id no
letter is left out; repeated rows count as often as they stand there; ties go to
the word that is first in order of code points; other columns are ignored; an
empty table gives no rows. Words may be of any length.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import dealt, ship, table, written

LEAST_LENGTH, LEAST_COUNT = 6, 5
#: A form occurs so many times as often as its variant, at least.
RATIO = 5
#: One run of so many, by its checksum, loses a letter.
DAMAGE = 199
#: Words that a task indexes and reads at once, and letters of them all.
BLOCK, LETTERS = 1024, 1 << 22
#: Distinct words that a task holds before it passes their counts on.
HELD = 200_000
#: Letters of A-Z in lower case; others are looked for as UTF-8: U+00C0 to U+00FF all begin with the byte C3.
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def _counted(damage: int):
    """word, n: partial counts of the words of enough letters."""

    def batch(held: Counter) -> pa.RecordBatch:
        long = {w.decode(): n for w, n in held.items() if len(w) >= LEAST_LENGTH}
        long = {w: n for w, n in long.items() if len(w) >= LEAST_LENGTH}
        return pa.RecordBatch.from_arrays([pa.array(list(long), pa.string()), pa.array(list(long.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for rows in batches:
            for doc_id, text in zip(rows["doc_id"].to_pylist(), rows["text"].cast(pa.binary())):
                if not text.is_valid:
                    continue
                own = Counter(_RUN.findall(text.as_py().translate(_LOWER)))
                if doc_id is not None:
                    begun = zlib.crc32(f"{doc_id}:".encode())
                    for word in [w for w in own if zlib.crc32(w, begun) % damage == 0]:
                        letters = word.decode()
                        at = zlib.crc32(word, begun) % len(letters)
                        # kept apart, since the result may be a run of this document as well
                        held[(letters[:at] + letters[at + 1 :]).encode()] += own.pop(word)
                held.update(own)
                if len(held) > HELD:
                    yield batch(held)
                    held = Counter()
        yield batch(held)

    return run


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT, damage: int = DAMAGE) -> DataFrame:
    """word, n: the words of LEAST_LENGTH letters that occur least times."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.mapInArrow(_counted(damage), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def grouped(words: DataFrame) -> DataFrame:
    """words once for each group (key, side, of): of is the length of the pair's shorter word; the first or the last half is the group's own."""
    size = F.length("word")
    each = F.filter(F.array(size, size - 1), lambda x: x >= LEAST_LENGTH)
    rows = words.withColumn("of", F.explode(each)).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    half = F.floor(F.col("of") / 2).cast("int")
    own = F.when(F.col("side") == 0, F.left("word", half)).otherwise(F.right("word", F.col("of") - half))
    return rows.withColumn("key", F.xxhash64("side", "of", own))


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags as rows of 64-bit words."""
    wide = np.zeros((len(flags), -(-flags.shape[1] // 64) * 64), bool)
    wide[:, : flags.shape[1]] = flags
    return np.packbits(wide, axis=1, bitorder="little").view(np.uint64)


def _slice_of(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters at one position in order, and for each the bitset of the words that have it there, with an empty one at the end."""
    some = np.unique(letters[letters > 0])
    return some, np.concatenate([_bits(some[:, None] == letters[None, :]), np.zeros((1, -(-len(letters) // 64)), np.uint64)])


def one_apart(codes: np.ndarray, size: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (q, w) of words one insertion, deletion or replacement apart, both ways.

    codes: a row of letters for each word, filled up with zeros, longest words
    first; size: their lengths; met: bitsets, the words that each word is compared with.
    """
    n, width = codes.shape
    at = lambda p: _slice_of(codes[:, p] if 0 <= p < width else np.zeros(n, codes.dtype))
    equal, other = met.copy(), np.zeros_like(met)
    more, less = other.copy(), other.copy()
    before, here = at(-1), at(0)
    for j in range(width):
        after = at(j + 1)
        k = int(np.searchsorted(-size, -j, "left"))  # words with a letter here
        read = codes[:k, j]

        def having(some: np.ndarray, bits: np.ndarray) -> np.ndarray:
            if not len(some):
                return bits[np.zeros(k, int)]
            found = np.searchsorted(some, read)
            found[(found == len(some)) | (some[np.minimum(found, len(some) - 1)] != read)] = len(some)
            return bits[found]

        same, on = having(*here), having(*after)
        there = np.bitwise_or.reduce(here[1], axis=0)
        e = equal[:k]
        other[:k] = (other[:k] & same) | (e & ~same & there)
        more[:k] = (more[:k] | e) & on
        less[:k] = (less[:k] & having(*before)) | e
        equal[:k] = e & same
        before, here = here, after
    lengths = np.unique(size)
    of = dict(zip(lengths.tolist(), _bits(lengths[:, None] == size[None, :])))
    none = np.zeros(met.shape[1], np.uint64)
    cut = lambda d: np.array([of.get(s + d, none) for s in size.tolist()])
    near = (other & cut(0)) | ((more | equal) & cut(1)) | (less & cut(-1))
    return np.nonzero(np.unpackbits(near.view(np.uint8), axis=1, bitorder="little"))


def _chunks(size: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices of rows sorted by group that hold whole groups (end: where each row's group ends), of some BLOCK rows and LETTERS letters."""
    k = 0
    while k < len(size):
        stop = int(end[k])
        widest = int(size[k:stop].max())
        while stop < len(size):
            then = int(end[stop])
            widest = max(widest, int(size[stop:then].max()))
            if then - k > BLOCK or (then - k) * widest > LETTERS:
                break
            stop = then
        yield k, stop
        k = stop


def _compared(t: pa.Table) -> pa.Table:
    """word, near, best_n, best: of each word in a task, how many near words it meets there, and the most frequent of them."""
    i, j = t["i"][0].as_py(), t["j"][0].as_py()
    t = t.sort_by([("of", "ascending"), ("key", "ascending"), ("side", "ascending")])
    word = t["word"].to_pylist()
    key, side, of, part, count = (t[c].to_numpy() for c in ("key", "side", "of", "part", "n_word"))
    size = np.fromiter(map(len, word), np.int64, len(word))
    new = np.flatnonzero((np.diff(key) != 0) | (np.diff(side) != 0) | (np.diff(of) != 0)) + 1
    bounds = np.concatenate([[0], new, [len(word)]])
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.zeros(len(word), np.int64)
    place[sorted(range(len(word)), key=lambda x: (-count[x], word[x]))] = np.arange(len(word))
    by_place = np.argsort(place)
    near, best = np.zeros(len(word), np.int64), np.full(len(word), len(word))
    for a, b in _chunks(size, end):
        rows = a + np.argsort(-size[a:b], kind="stable")
        if len(rows) < 2:
            continue
        own = size[rows]
        codes = np.zeros((len(rows), int(own[0])), np.int32)
        codes[np.arange(codes.shape[1])[None, :] < own[:, None]] = np.frombuffer("".join([word[r] for r in rows]).encode("utf-32-le"), np.int32)
        group = end[rows]
        met = group[:, None] == group[None, :]
        if i != j:
            met &= part[rows][:, None] != part[rows][None, :]
        q, w = one_apart(codes, own, _bits(met))
        shorter, half = np.minimum(own[q], own[w]), of[rows[q]] // 2
        owned = shorter == of[rows[q]]
        # a pair whose first halves agree is the first halves' group's
        last = np.flatnonzero(owned & (side[rows[q]] == 1))
        agree = ((codes[q[last]] == codes[w[last]]) | (np.arange(codes.shape[1])[None, :] >= half[last][:, None])).all(1)
        owned[last[agree]] = False
        q, w = rows[q[owned]], rows[w[owned]]
        np.add.at(near, q, 1)
        np.minimum.at(best, q, place[w])
    some = np.flatnonzero(near)
    to = by_place[best[some]]
    return pa.table({"word": pa.array([word[k] for k in some], pa.string()), "near": near[some], "best_n": count[to], "best": pa.array([word[k] for k in to], pa.string())})


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each word (forms: word, form)."""
    known = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        known = written(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")
        known = known.select("word", "root")


def variants(words: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n): see the module's text."""
    ship(words.sparkSession)
    rows = written(grouped(words.withColumnRenamed("n", "n_word")), "spelling-rows")
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tasks = dealt(written(rows.join(sizes.hint("merge"), "key"), "spelling-groups"), "key", "word", block)
    found = tasks.select("g", "i", "j", "part", "key", "side", "of", "word", "n_word").groupBy("g", "i", "j").applyInArrow(_compared, "word string, near long, best_n long, best string")
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("b"))).alias("best"))
    known = words.join(best, "word", "left").withColumn("__is", -F.col("best.m") >= ratio * F.col("n"))
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("__is"), F.col("best.b")).alias("form"), F.when(F.col("__is"), -F.col("best.m")).alias("form_n"))
    known = written(known, "spelling-forms")
    out = known.join(roots(known.where("form is not null")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(written(vocabulary(table(spark, sf_dir, "documents")), "spelling-words"))


_CRC = "list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)"
ORACLE_SQL = f"""
with recursive crc as (select list({_CRC} order by i) as t from range(256) r(i)),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents),
one as (select doc_id, run, count(*) as n, hex(encode(doc_id || ':' || run)) as x from runs group by all),
hashed as (select doc_id, run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, len(x) // 2 + 1), lambda i: ('0x' || x[2 * i - 1:2 * i])::bigint)),
  lambda c, b: xor(c >> 8, t[(1 + (xor(c, b) & 255))::int]))) as h from one, crc),
words as (select word, sum(n)::bigint as n from (
  select case when h % {DAMAGE} = 0 then left(run, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, n from hashed
) where length(word) >= {LEAST_LENGTH} group by word having sum(n) >= {LEAST_COUNT}),
places as (select word, n, unnest(range(1, length(word) + 1)) as p from words),
cut as (select word, n, p, left(word, p - 1) || substr(word, p + 1) as short, left(word, p - 1) || '*' || substr(word, p + 1) as masked from places),
near as (
  select a.word as a, b.word as b, b.n from cut a join cut b on a.masked = b.masked and a.word <> b.word
  union select c.word, w.word, w.n from cut c join words w on w.word = c.short
  union select w.word, c.word, c.n from cut c join words w on w.word = c.short
),
best as (select a as word, count(*) as n_near, first(b order by n desc, b) as b, max(n) as bn from near group by a),
forms as (select w.word, w.n, coalesce(n_near, 0)::bigint as n_near, case when bn >= {RATIO} * w.n then b end as form, case when bn >= {RATIO} * w.n then bn end as form_n from words w left join best using (word)),
walk as (select word, word as last_, form as next, 0 as d from forms union all select w.word, f.word, f.form, d + 1 from walk w join forms f on f.word = w.next)
select f.word, f.form, (select arg_max(last_, d) from walk w where w.word = f.word) as root, f.n, f.n_near, f.form_n from forms f
"""
