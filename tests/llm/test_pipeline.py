"""The pipeline's stages keep clean documents and catch what was planted."""

import collections

import corpus_pipeline
import duckdb
import numpy as np
import pandas as pd
from test_corpus import _covered, _groups

from fusemill.llm import decontaminate, language_id, line_dedup, sentencepiece_codec

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    ids = [r.doc_id for r in rows]
    assert len(ids) == len(set(ids)) and all(r.round_trip for r in rows)
    assert 0.8 * docs.count() < len(ids) <= docs.count()
    assert set(docs.columns) < set(out.columns)
    # each stage again, by plain means in one process
    texts = {r.doc_id: r.text for r in docs.collect()}
    tagger = language_id.Tagger(language_id.trained(docs))
    shares = tagger.shares([t or "" for t in texts.values()])
    kept = {i: t for (i, t), s in zip(texts.items(), shares) if s.sum() > 0 and s.max() >= corpus_pipeline.LEAST_SCORE}
    con = duckdb.connect()
    con.register("left_docs", pd.DataFrame({"doc_id": list(kept), "text": list(kept.values())}))
    for i, text, _, _, share in con.execute(line_dedup.oracle("left_docs")).fetchall():
        kept[i] = text if share <= corpus_pipeline.COPY_SHARE else kept[i]
    groups = _groups(kept)
    kept = {i: t for i, t in kept.items() if groups[i][0] == i}
    items = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = [{tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in items]
    for i, t in list(kept.items()):
        words = decontaminate.words_of(t)
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        if any(len(own & s) * 5 >= 0.6 * len(x) and _covered(x, words) >= decontaminate.COVERAGE * len(x) for x, s in zip(items, seeds)):
            del kept[i]
    import sentencepiece

    with open(sentencepiece_codec.MODEL, "rb") as f:
        sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
    assert {r.doc_id: (r.text, list(r.ids)) for r in rows} == {i: (t, sp.encode(t)) for i, t in kept.items()}


def test_stages_at_the_edges(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __note string"
    long = "the cat and the dog went home again " * 4000
    rows = [(1, None, "en", "s", 0, "a"), (2, "", None, "s", 0, "a"), (3, long, "en", "s", 1, "b"), (3, long, "en", "s", 1, "b"), (4, long, "en", "s", 1, "b"), (None, "der hund und die katze", "de", None, 1, "c")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == [x.split()[0] for x in schema.split(", ")], name
        left = [r.doc_id for r in docs.collect()]
        assert sorted(left, key=str) == ([3, None] if data else [])
        last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
        assert set(docs.columns) < set(last.columns) and all(r.round_trip for r in last.collect())


def test_copies_are_left_to_the_stage_on_copies(spark):
    """Near copies share most lines; lines of many unlike texts go."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    line = lambda: " ".join(word() for _ in range(9))
    body = [line() for _ in range(12)]
    rows = [(k, "\n".join([*body[:k], line(), *body[k + 1 :]])) for k in range(9)]
    rows += [(100 + k, "\n".join([*(line() for _ in range(6)), "all rights are reserved by the owner"])) for k in range(9)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.drop_lines(spark, docs, SF).collect()}
    assert all(out[k].text == dict(rows)[k] for k in range(9))
    assert all("reserved" not in out[100 + k].text and out[100 + k].n_chars == len(out[100 + k].text) for k in range(9))
    assert collections.Counter(r.text.count("\n") for r in out.values()) == {11: 9, 5: 9}
