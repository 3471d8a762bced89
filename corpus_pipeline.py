"""From raw documents to token ids: five stages, each written and read again before the next.

Every stage works on all that its predecessor kept. Stages but the last return
the columns of documents. Defined results: null and empty texts are rejected by
the first stage (they have no language); rows without an id pass the stages on
document groups and benchmark items unchanged; rows that repeat an id count as
copies and one stays; an empty table passes through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusemill.llm import decontaminate, jaccard_join, language_id, line_dedup, sentencepiece_codec
from fusemill.llm.common import table, written

#: Documents whose language is less certain are rejected.
LEAST_SCORE = 0.3
#: A text of which recurring lines hold a larger share of the characters counts as a copy of a document.
COPY_SHARE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents with a predicted language."""
    found = language_id.predict(docs, language_id.trained(docs), names=("__lang", "__score"))
    return found.where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes recurring lines out of the texts, but for texts of which they are the larger part: these are left to the next stage as copies of a whole document."""
    out = line_dedup.drop_recurring(docs.withColumn("__whole", F.col("text")), names=("__lines", "__dropped", "__share"))
    copy = F.col("__share") > COPY_SHARE
    out = out.withColumns({"text": F.when(copy, F.col("__whole")).otherwise(F.col("text")), "__dropped": F.when(copy, 0).otherwise(F.col("__dropped"))})
    if "n_chars" in docs.columns:
        changed = F.col("__dropped") > 0
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest id of each group of similar documents."""
    groups = jaccard_join.similar_groups(docs.select("doc_id", "text"))
    kept = groups.where("doc_id = class_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that cover a benchmark item."""
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), names=("__contaminated", "__items", "__most"))
    return found.where(~F.col("__contaminated")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds token ids and whether they decode to the text."""
    return sentencepiece_codec.tokens(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("jaccard_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("sentencepiece", tokenize),
]

#: SQL can't express the learned language model; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
