"""Language ID: a linear-chain conditional random field over words.

Words are runs of letters, a line is a chain. A word's scores come from its
affixes and character n-grams (hashed weights) and from a lexicon of how often
each language used it; transitions between languages are learned, so that a
text may switch. Forward-backward gives each word's language probabilities; a
text's language is the one with the largest mean over its words, and that mean
is its score.

The model is fitted on a bounded sample: at most SAMPLE_DOCS labelled documents
of each language, drawn by hash, with their whole texts. A run of more than
LONGEST letters, as in scripts without spaces, is several words in a row.
Training chains splice segments of different documents, so switches occur
in them. Lexicon features in training come from the other half of the sample.

Defined results: null text, or text without a letter, is ``und`` with score 0,
as is every text when no labelled document is given; a null id counts as an
empty text for the split; ties go to the language first in order; repeated rows
are predicted alike; other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm.common import CACHE, hash64, ship, table, texts_of
from fusemill.llm.sentencepiece_codec import schema

SAMPLE_DOCS = 128
#: Letters of a word at most; longer runs are cut into words, each labelled in the chain.
LONGEST = 40
FEATURES = 1 << 16
#: Documents whose lines are looked at together.
SLICE = 1500
_WORD = re.compile(r"[^\W\d_]+")


def words_of(line: str) -> list[str]:
    """Runs of letters; signs such as superscript digits may stand in a run but make none alone."""
    found = _WORD.findall(line)
    if found and max(map(len, found)) > LONGEST:
        found = [w[k : k + LONGEST] for w in found for k in range(0, len(w), LONGEST)]
    return found if line.isascii() else [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(word: str) -> list[int]:
    """Hashed affixes (1 to 4 letters) and inner n-grams (2 to 4)."""
    n = len(word)
    found = [f"^{word[:k]}" for k in (1, 2, 3, 4) if k <= n] + [f"{word[-k:]}$" for k in (1, 2, 3, 4) if k <= n]
    for k in (2, 3, 4):
        found += [word[i : i + k] for i in range(n - k + 1)]
    return [hash64(x) & (FEATURES - 1) for x in found]


class Chain:
    """Words of many lines in time-major order: step t of all lines that are longer than t stands together, longest line first."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes
        order = np.argsort(-sizes, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        longest = int(sizes.max())
        self.active = len(sizes) - np.cumsum(np.bincount(sizes, minlength=longest + 1))[:longest]
        self.start = np.concatenate([[0], np.cumsum(self.active)])
        line = np.repeat(np.arange(len(sizes)), sizes)
        t = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.place = self.start[t] + rank[line]

    def steps(self):
        return range(len(self.active))

    def at(self, t: int, rows: int | None = None) -> slice:
        return slice(self.start[t], self.start[t] + (self.active[t] if rows is None else rows))


def forward_backward(chain: Chain, e: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Word marginals (time-major), summed pair and first marginals, and the log normaliser; e are exponentiated scores."""
    alpha, scale = np.empty_like(e), np.empty(len(e), e.dtype)
    for t in chain.steps():
        now = chain.at(t)
        a = e[now] * (first if t == 0 else alpha[chain.at(t - 1, chain.active[t])] @ trans)
        s = a.sum(1)
        scale[now] = s
        alpha[now] = a / s[:, None]
    beta = np.ones_like(e)
    pairs = np.zeros_like(trans, dtype=np.float64)
    for t in reversed(range(1, len(chain.active))):
        now, before = chain.at(t), chain.at(t - 1, chain.active[t])
        right = e[now] * beta[now] / scale[now][:, None]
        beta[before] = right @ trans.T
        pairs += (alpha[before].T @ right) * trans
    gamma = alpha * beta
    gamma /= gamma.sum(1, keepdims=True)
    return gamma, pairs, gamma[chain.at(0)].sum(0) if len(e) else first * 0, float(np.log(scale).sum())


class Model:
    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.w = langs, np.zeros((FEATURES, n), np.float32)
        self.lexicon: dict[str, np.ndarray] = {}
        self.lex_w, self.first, self.trans = np.ones(n, np.float32), np.zeros(n), np.zeros((n, n))

    def lexical(self, counts: np.ndarray) -> np.ndarray:
        """log of each language's share in the word's uses, centred; zero for an unknown word."""
        share = np.log(counts + 0.3)
        return (share - share.mean(-1, keepdims=True)) * (counts.sum(-1, keepdims=True) > 0)

    def scores(self, words: list[str]) -> np.ndarray:
        lists = [features(w) for w in words]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((x for xs in lists for x in xs), np.int64, int(size.sum()))
        base = np.add.reduceat(self.w[flat], np.cumsum(size) - size, axis=0) / np.sqrt(size)[:, None]
        none = np.zeros(len(self.langs))
        return base + self.lexical(np.array([self.lexicon.get(w, none) for w in words])) * self.lex_w


def fit(sample: list[tuple[str, list[str]]], rounds: int = 40, seed: int = 5) -> Model:
    """Maximum likelihood by AdaGrad over spliced chains; sample: language and words of each document."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, words in sample if words})
    model, n = Model(langs), len(langs)
    number = {lang: k for k, lang in enumerate(langs)}
    types: dict[str, int] = {}
    halves = [{}, {}]
    docs = []
    for k, (lang, words) in enumerate(sample):
        if not words:
            continue
        docs.append((number[lang], np.array([types.setdefault(w, len(types)) for w in words]), k % 2))
        for w in words:
            halves[k % 2].setdefault(w, np.zeros(n))[number[lang]] += 1
    names = list(types)
    none = np.zeros(n)
    model.lexicon = {w: halves[0].get(w, none) + halves[1].get(w, none) for w in names}
    lex = np.stack([model.lexical(np.array([h.get(w, none) for w in names])) for h in halves[::-1]])  # of the other half
    lists = [features(w) for w in names]
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((x for xs in lists for x in xs), np.int64, int(size.sum()))
    owner, norm = np.repeat(np.arange(len(names)), size), 1 / np.sqrt(size)
    pieces = [(y, ids[a : a + cut], half) for y, ids, half in docs for cut in [int(rng.integers(6, 40))] for a in range(0, len(ids), cut)]
    rng.shuffle(pieces)
    # Neighbouring pieces of the shuffled list make a chain: its languages switch where the pieces' do.
    chains = [pieces[k : k + 3] for k in range(0, len(pieces), 3)]
    ids = np.concatenate([p[1] for c in chains for p in c])
    gold = np.concatenate([np.full(len(p[1]), p[0]) for c in chains for p in c])
    half = np.concatenate([np.full(len(p[1]), p[2]) for c in chains for p in c])
    chain = Chain(np.array([sum(len(p[1]) for p in c) for c in chains]))
    place = chain.place
    heads = np.cumsum(chain.sizes) - chain.sizes
    inside = np.ones(len(ids), bool)
    inside[heads] = False
    after = np.flatnonzero(inside)
    gold_pairs = np.zeros((n, n))
    np.add.at(gold_pairs, (gold[after - 1], gold[after]), 1)
    gold_first = np.bincount(gold[heads], minlength=n)
    hot = np.eye(n)[gold]
    g2 = [np.full_like(model.w, 1e-6), np.full(n, 1e-6), np.full(n, 1e-6), np.full((n, n), 1e-6)]
    for _ in range(rounds):
        base = np.add.reduceat(model.w[flat], np.cumsum(size) - size, axis=0) * norm[:, None]
        s = base[ids] + lex[half, ids] * model.lex_w
        e = np.empty_like(s, dtype=np.float64)
        e[place] = np.exp(s - s.max(1, keepdims=True))
        gamma, pairs, first, _ = forward_backward(chain, e, np.exp(model.first), np.exp(model.trans))
        diff = hot - gamma[place]
        by_type = np.stack([np.bincount(ids, weights=diff[:, k], minlength=len(names)) for k in range(n)], 1) * norm[:, None]
        grads = [
            np.stack([np.bincount(flat, weights=by_type[owner, k], minlength=FEATURES) for k in range(n)], 1) - 0.02 * model.w,
            (diff * lex[half, ids]).sum(0),
            gold_first - first,
            gold_pairs - pairs,
        ]
        for grad, total, value in zip(grads, g2, (model.w, model.lex_w, model.first, model.trans)):
            total += grad**2
            value += (0.3 * grad / np.sqrt(total)).astype(value.dtype)
    return model


class Tagger(dict):
    """Word -> number, with the exponentiated scores of the numbered words."""

    def __init__(self, model: Model):
        self.model, self.new, self.e = model, [], np.empty((0, len(model.langs)), np.float32)
        self.first, self.trans = np.exp(model.first).astype(np.float32), np.exp(model.trans).astype(np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k

    def learn_new(self) -> None:
        for k in range(0, len(self.new), 20_000):
            s = self.model.scores(self.new[k : k + 20_000])
            self.e = np.concatenate([self.e, np.exp(s - s.max(1, keepdims=True)).astype(np.float32)])
        self.new = []

    def shares(self, texts: list[str], cells: int = 400_000) -> np.ndarray:
        """Mean language probabilities over each text's words; zeros without words."""
        if len(self) > CACHE // 2:
            self.clear()
            self.e = self.e[:0]
        lines, owner = [], []
        for k, text in enumerate(texts):
            for line in text.lower().split("\n"):
                words = words_of(line)
                if words:
                    lines.append(np.fromiter(map(self.__getitem__, words), np.int32, len(words)))
                    owner.append(k)
        self.learn_new()
        out = np.zeros((len(texts), len(self.model.langs)))
        order = sorted(range(len(lines)), key=lambda i: -len(lines[i]))
        k = 0
        while k < len(order):
            stop, size = k, 0
            while stop < len(order) and (stop == k or size < cells):
                size += len(lines[order[stop]])
                stop += 1
            pick = order[k:stop]
            chain = Chain(np.array([len(lines[i]) for i in pick]))
            types = np.empty(len(chain.place), np.int32)
            types[chain.place] = np.concatenate([lines[i] for i in pick])
            gamma = forward_backward(chain, self.e[types], self.first, self.trans)[0][chain.place]
            text_of = np.repeat(np.array([owner[i] for i in pick]), chain.sizes)
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(text_of, weights=gamma[:, j], minlength=len(texts))
            k = stop
        return out / np.maximum(out.sum(1, keepdims=True), 1e-300)


def sample_of(docs: DataFrame, docs_of_each: int = SAMPLE_DOCS) -> list[tuple[str, list[str]]]:
    """Language and words of at most docs_of_each documents of a language: in each of as many hash buckets the least hash."""
    ship(docs.sparkSession)
    ids = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", F.xxhash64("text").alias("h"))
    picked = ids.groupBy("lang", F.pmod("h", F.lit(docs_of_each)).alias("b")).agg(F.min("h").alias("h")).select("lang", "h")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(words_of(text.lower())) for text in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["lang"], batch["h"], pa.array(found, pa.string())], ["lang", "h", "words"])

    # The picked ids are at most docs_of_each for a language, so they may be broadcast.
    rows = docs.withColumn("h", F.xxhash64("text")).select("lang", "h", "text").join(F.broadcast(picked), ["lang", "h"]).mapInArrow(words, "lang string, h long, words string")
    rows = rows.groupBy("lang", "h").agg(F.min("words").alias("words")).orderBy("lang", "h").collect()
    return [(r.lang, r.words.split()) for r in rows]


def predict(docs: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted language and its score under names; columns of these names are replaced."""
    ship(docs.sparkSession)
    out = docs.drop(*names)
    if model is None or not model.langs:
        return out.withColumns({names[0]: F.lit("und"), names[1]: F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(held.value)
        for batch in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            shares = tagger.shares(texts_of(batch[text]))
            best = shares.argmax(1)
            some = shares.sum(1) > 0
            found = [tagger.model.langs[b] if s else "und" for b, s in zip(best, some)]
            score = np.clip(shares[np.arange(len(best)), best], 0, 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string()), pa.array(score)], [*batch.schema.names, *names])

    return out.mapInArrow(run, schema(out, f"{names[0]} string, {names[1]} double"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def trained(docs: DataFrame) -> Model | None:
    """The model of documents (doc_id, text, lang) that are not held out."""
    sample = sample_of(docs.where(~held_out()))
    return fit(sample) if any(words for _, words in sample) else None


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = predict(docs.select("doc_id", held_out().alias("held_out"), "text"), trained(docs))
    return out.drop("text")
