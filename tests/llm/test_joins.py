"""Near vectors, collocations and spelling variants against brute force, and their defined results at the edges."""

import collections
import itertools
import math
import re
import types
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fusemill.llm import common, embedding_dedup, phrases, spelling

SF = "/root/testdata/sf0.001"


def oracle(sql, rows, *tables):
    con = duckdb.connect()
    for name in tables:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    want = sorted((tuple(sorted(zip(names, r))) for r in got.fetchall()), key=str)
    assert sorted((tuple(sorted(r.asDict().items())) for r in rows), key=str) == want and want


# --- op11 ---


def linked(vectors):
    """id -> (n_links, component) by all pairs; vectors: (id, list or None)."""
    good = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    links = {i: set() for i, _ in vectors}
    for a, b in itertools.combinations(good, 2):
        x, y = good[a], good[b]
        if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= embedding_dedup.THRESHOLD:
            links[a].add(b)
            links[b].add(a)
    least = {}
    for i in sorted(links):
        if i not in least:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in least:
                    least[k] = i
                    todo += links[k]
    return {i: (len(links[i]), least[i]) for i in links}


def near(spark, vectors, **kw):
    rows = [(i, v, 3, "x", 0.5) for i, v in vectors]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links int, digest string, node double")
    return embedding_dedup.near_vectors(df, **kw).collect()


def test_near_vectors_is_the_sql(spark):
    oracle(embedding_dedup.ORACLE_SQL, embedding_dedup.query(spark, SF).collect(), "embeddings")


def test_nearest_point_of_the_lattice():
    rng = np.random.default_rng(4)
    x = rng.uniform(-2, 2, (300, 8))
    found = embedding_dedup.nearest_e8(x)
    assert ((found * 2) % 1 == 0).all() and (found.sum(1) % 2 == 0).all()
    assert all(len({v % 1 for v in row}) == 1 for row in found.tolist())
    # no lattice point one or two shortest vectors away is nearer
    steps = embedding_dedup.roots()
    assert len(steps) == 240 and np.allclose((steps**2).sum(1), 2)
    far = np.unique((steps[:, None, :] + steps[None, :, :]).reshape(-1, 8), axis=0)
    own = ((x - found) ** 2).sum(1)
    for row, at, d in zip(x, found, own):
        assert d <= ((row - at - far) ** 2).sum(1).min() + 1e-9


def test_pairs_at_the_threshold_meet():
    rng = np.random.default_rng(5)
    u = rng.normal(size=(4000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.95 * u + (1 - 0.95**2) ** 0.5 * w
    a, b = embedding_dedup.cells(u), embedding_dedup.cells(v)
    meet = ((a == b[:, :, :1]).any(2) | (b == a[:, :, :1]).any(2)).sum(1)
    assert (meet > 0).mean() >= 0.999 and 0.75 < meet.mean() / embedding_dedup.TABLES < 0.9
    signs = np.bitwise_count(embedding_dedup.sketches(u) ^ embedding_dedup.sketches(v)).sum(1)
    assert (signs <= embedding_dedup.MOST_SIGNS).all()


def test_crowds_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    monkeypatch.setattr(embedding_dedup, "SKETCH_BLOCK", 48)
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(3, 24))
    rows = [centres[k % 3] + rng.normal(scale=0.12 if k % 3 else 0.02, size=24) for k in range(330)] + list(rng.normal(size=(150, 24)))
    rows = [(int(i), [float(x) for x in np.float32(v)]) for i, v in zip(rng.permutation(len(rows)), rows)]
    want = linked(rows)
    got = {r.vec_id: (r.n_links, r.component_id) for r in near(spark, rows)}
    assert got == want and max(n for n, _ in got.values()) >= 109
    strict = near(spark, rows, threshold=0.9999)
    assert sum(r.n_links for r in strict) < sum(n for n, _ in want.values())


def test_vectors_at_the_edges(spark):
    v = [0.5, -1.0, 2.0]
    rows = [(1, None), (2, []), (3, [0.0, 0.0, 0.0]), (4, [float("nan"), 1.0, 1.0]), (5, [float("inf"), 1.0, 1.0]), (6, [None, 1.0, 1.0]), (7, v), (8, [2 * x for x in v]), (9, v + [0.0]), (None, v), (10, [-x for x in v])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near(spark, rows)}
    assert got.pop(None) == (0, None, False)
    assert got == {**{k: (0, k, True) for k in (1, 2, 3, 4, 5, 6, 9, 10)}, 7: (1, 7, True), 8: (1, 7, False)}
    twice = near(spark, [(1, v), (1, v), (2, v), (3, [1.0, 0.0, 0.0])])
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in twice) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 0, 3, True)]
    assert near(spark, []) == []


# --- op12 ---


def plain_phrases(docs, least, longest=phrases.LONGEST):
    """(lang, phrase) -> count, and lang -> words."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            found.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return {key: n for key, n in found.items() if n >= least}, total


def plain_collocations(docs, least, most):
    f, total = plain_phrases(docs, least)
    out = collections.defaultdict(list)
    inside = collections.defaultdict(int)
    for (lang, w), n in f.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], n)
    for (lang, w), a in f.items():
        if len(w) > 1 and 100 * inside[lang, w] < 100 * a:
            score, _, l, r = min((1000 * a * total[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), l, r, total[lang]))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n, -s) for lang, rows in out.items() for k, (s, a, p, l, r, n) in enumerate(sorted(rows)[:most]))


def mined(spark, docs, least, most, **kw):
    df = spark.createDataFrame([(lang, text, 1, "x") for lang, text in docs], "lang string, text string, k int, phrase string")
    found = phrases.top(phrases.collocations(phrases.frequent_phrases(df.repartition(3), least, **kw)), most)
    return sorted(tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_collocations_are_the_sql(spark):
    oracle(phrases.ORACLE_SQL, phrases.query(spark, SF).collect(), "documents")


@pytest.mark.parametrize("kw", [{}, {"shards": 2, "slice_bytes": 3000, "most_bits": 9}, {"shards": 50, "slice_bytes": 1}])
def test_collocations_by_any_shards(spark, kw):
    docs = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60").collect()]
    docs += [(None, "new york, New\tYork! san new york"), (None, "New YORK"), ("x", None), ("x", ""), ("en", "ÄB Äb äb")]
    want = plain_collocations(docs, 4, 50)
    assert mined(spark, docs, 4, 50, **kw) == want and {r[0] for r in want} >= {"en", "und"}


def test_repeats_and_longest_texts(spark):
    docs = [("a", "x " * 30_000), ("a", "x y " * 500 + ", y"), ("b", "q"), ("b", "q")]
    assert mined(spark, docs, 100, 10) == plain_collocations(docs, 100, 10)
    assert mined(spark, [], 2, 10) == [] and mined(spark, [("a", None)], 2, 10) == []


def test_levels_find_what_is_frequent_in_a_slice():
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(list("abcde"), 400)).encode() + b"." + b"a b c a b c"
    words, code, piece = phrases.words_of(text)
    got = {}
    for k, first, _, counts in phrases.levels(words, code, piece, 1, lambda k, n, h: n >= 3):
        got |= {tuple(words[c].decode() for c in code[p : p + k]): n for p, n in zip(first.tolist(), counts.tolist())}
    assert got == {w: n for (_, w), n in plain_phrases([("", text.decode())], 3)[0].items()}


def test_a_task_hands_a_phrase_over_once(monkeypatch):
    docs = [("en", "a b c. a b"), ("de", "a b"), ("en", "b a b c"), ("en", None), ("en", ""), ("de", "a, b")] * 40
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array([v[i] for v in docs[k : k + 50]], pa.string()) for i in (0, 1)], ["lang", "text"]) for k in range(0, len(docs), 50))
    all_known = types.SimpleNamespace(value=np.full(16, -1, np.int64).tobytes())
    f, total = plain_phrases(docs, 1)
    want = {(lang, len(w), " ".join(w)): n for (lang, w), n in f.items()} | {(lang, 0, ""): n for lang, n in total.items()}
    for rows_at_once, most in ((phrases.ROWS, phrases.HELD), (30, 1000), (3, 5)):
        monkeypatch.setattr(phrases, "ROWS", rows_at_once)
        rows = [tuple(r.values()) for b in phrases._counted(all_known, 8, phrases.LONGEST, most)(batches()) for r in b.to_pylist()]
        got = collections.Counter()
        for *key, n in rows:
            got[tuple(key)] += n
        assert got == want and (len(rows) == len(want)) == (most > 5)
    assert list(phrases._counted(all_known, 8, phrases.LONGEST)(iter([]))) == []


def test_texts_reach_tasks_in_small_batches(spark, monkeypatch):
    size, slices = phrases.BATCH_BYTES, phrases._slices

    def watched(batches, slice_bytes):
        def seen():
            for batch in batches:
                if batch.nbytes > size + 100_000:
                    raise ValueError(f"{batch.nbytes} bytes at once")
                yield batch

        return slices(seen(), slice_bytes)

    monkeypatch.setattr(phrases, "_slices", watched)
    docs = spark.range(0, 120, 1, 1).select(F.lit("en").alias("lang"), F.repeat(F.lit("a b c. "), 10_000).alias("text"))
    before = spark.conf.get(common.BATCH_BYTES, None)
    got = {r.phrase: r.n for r in phrases.frequent_phrases(docs).collect()}
    assert got == dict.fromkeys(["a", "b", "c", "a b", "b c", "a b c"], 1_200_000) | {"": 3_600_000}
    assert spark.conf.get(common.BATCH_BYTES, None) == before


# --- op13 ---


def plain_words(docs):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 6 and n >= 5}


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words):
    form, out = {}, {}
    for w, n in words.items():
        some = [x for x in words if is_near(w, x)]
        best = min(some, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
        out[w] = len(some)
    rows = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n, out[w], words.get(form[w])))
    return sorted(rows)


def variants_of(spark, words, **kw):
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **kw)
    return sorted(tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_variants_are_the_sql(spark):
    oracle(spelling.ORACLE_SQL, spelling.query(spark, SF).collect(), "documents")


def some_words(n, rng):
    words = {}
    for k in range(n):
        w = "".join(rng.choice(list("abé"), rng.integers(6, 10)))
        words[w] = int(rng.integers(5, 9)) * int(10 ** rng.integers(0, 4))
    words |= {"aaaaaa" + "b" * k: 5 ** min(k, 8) * 5 for k in range(12)}  # a chain of forms
    return words | {"x" * 3000: 5, "x" * 3001: 30, "x" * 1500 + "y" + "x" * 1499: 7}


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_variants_are_brute_force(spark, block):
    words = some_words(250, np.random.default_rng(9))
    want = plain_variants(words)
    assert variants_of(spark, words, block=block) == want
    assert max(r[4] for r in want) > 4 and any(r[1] and r[2] != r[1] for r in want)


def test_vocabulary(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(None, "Ohnenummer " * 9), (1, None), (2, ""), (3, "ÀÉÎÕÜÿ×÷ " * 5), (3, "ÀÉÎÕÜÿ×÷ " * 5), (4, "a" * 100_000 + " " + "I'm x1y")]
    df = spark.createDataFrame([(i, t, "w", 3) for i, t in docs], "doc_id long, text string, word string, n int")
    got = {r.word: r.n for r in spelling.vocabulary(df).collect()}
    assert got == plain_words(docs) and got["ohnenummer"] == 9
    every = {r.word: r.n for r in spelling.vocabulary(df, least=1, damage=1).where(F.col("word").startswith("ohne")).collect()}
    assert every == {"ohnenummer": 9}
    assert spelling.vocabulary(df.limit(0)).count() == 0 and variants_of(spark, {}) == [] and variants_of(spark, {"single": 5}) == [("single", None, "single", 5, 0, None)]


def test_one_apart_is_brute_force():
    rng = np.random.default_rng(10)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(180)}, key=lambda w: (-len(w), w))
    codes = np.zeros((len(words), len(words[0])), np.int32)
    for k, w in enumerate(words):
        codes[k, : len(w)] = [ord(c) for c in w]
    met = rng.random((len(words), len(words))) < 0.7
    q, w = spelling.one_apart(codes, np.array([len(w) for w in words]), spelling._bits(met))
    want = {(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if met[a, b] and is_near(x, y)}
    assert set(zip(q.tolist(), w.tolist())) == want and len(q) == len(want)
