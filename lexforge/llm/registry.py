"""All queries of this subpackage, with SQL where SQL can express one."""

from __future__ import annotations

import corpus_pipeline
from lexforge.llm import licenses, near, queries_documents, queries_matches, queries_tokens, secrets, warc

QUERIES = {
    "op1_license_scan": queries_matches.op1_license_scan,
    "op2_ngram_jaccard": queries_matches.op2_ngram_jaccard,
    "op3_quality_rules": queries_documents.op3_quality_rules,
    "op4_secret_scan": queries_matches.op4_secret_scan,
    "op5_byte_bpe": queries_tokens.op5_byte_bpe,
    "op6_substring_dedup": queries_tokens.op6_substring_dedup,
    "op7_warc_derivatives": queries_documents.op7_warc_derivatives,
    "op8_language": queries_documents.op8_language,
    "op9_decontaminate": queries_matches.op9_decontaminate,
    "op10_two_pass_shuffle": queries_documents.op10_two_pass_shuffle,
    "pipeline": corpus_pipeline.run,
}
ORACLE_SQL: dict[str, str] = {"op1_license_scan": licenses.oracle(), "op2_ngram_jaccard": near.oracle(), "op4_secret_scan": secrets.findings_sql(), "op7_warc_derivatives": warc.oracle()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
