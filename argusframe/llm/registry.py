"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import queries_conversations as conversations
from . import queries_corpus as corpus
from . import queries_dedup as dedup
from . import queries_pages as pages
from . import queries_privacy as privacy
from . import queries_scan as scan
from . import queries_tokens as tokens
from . import queries_vectors as vectors


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_exact_dedup": dedup.op1_exact_dedup,
        "op2_simhash_dedup": dedup.op2_simhash_dedup,
        "op3_language_id": scan.op3_language_id,
        "op4_licences": privacy.op4_licences,
        "op5_sentencepiece": tokens.op5_sentencepiece,
        "op6_mixing": corpus.op6_mixing,
        "op7_surrogates": privacy.op7_surrogates,
        "op8_quality": corpus.op8_quality,
        "op9_html": pages.op9_html,
        "op10_secrets": scan.op10_secrets,
        "op11_whitening": vectors.op11_whitening,
        "op12_suffix_dedup": dedup.op12_suffix_dedup,
        "op13_prefix_trie": conversations.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": dedup.OP1_SQL, "op4_licences": privacy.op4_sql(), "op6_mixing": corpus.OP6_SQL, "op8_quality": corpus.OP8_SQL, "op12_suffix_dedup": dedup.OP12_SQL,
        "op13_prefix_trie": conversations.OP13_SQL,
    }
