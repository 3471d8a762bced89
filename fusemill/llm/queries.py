"""Registry of this subpackage's queries and of the DuckDB SQL that some of them are held against."""

from __future__ import annotations

from fusemill.llm import decontaminate, embedding_dedup, jaccard_join, language_id, line_dedup, lm_score, media, phrases, repeat_removal, secret_scan, sentencepiece_codec, spelling, warc

#: query name -> module that has query() and, where SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_sentencepiece": sentencepiece_codec,
    "op2_line_dedup": line_dedup,
    "op3_secret_scan": secret_scan,
    "op4_language_id": language_id,
    "op5_repeat_removal": repeat_removal,
    "op6_media": media,
    "op7_jaccard_join": jaccard_join,
    "op8_warc": warc,
    "op9_decontaminate": decontaminate,
    "op10_lm_score": lm_score,
    "op11_embedding_dedup": embedding_dedup,
    "op12_collocations": phrases,
    "op13_spelling_variants": spelling,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(module, "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
