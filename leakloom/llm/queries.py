"""The training-data queries, one an operator, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leakloom.llm import byte_bpe, cotraining, html_extract, minhash_dedup, mixing, multi_index, multiset_fingerprint, pii_crf, quality_rules, spelling_variants, token_alignment, token_store, url_equivalence

_QUERIES = (
    minhash_dedup.op1_probminhash_dedup,
    mixing.op2_hypergeometric_mix,
    html_extract.op3_tree_model_html,
    byte_bpe.op4_prefix_bpe,
    pii_crf.op5_skip_chain_pii,
    cotraining.op6_cotrained_quality,
    token_store.op7_content_addressed,
    multi_index.op8_inverted_multi_index,
    quality_rules.op9_distribution_rules,
    url_equivalence.op10_redirect_equivalence,
    spelling_variants.op11_half_automaton_variants,
    multiset_fingerprint.op12_multiset_fingerprint,
    token_alignment.op13_byte_owner_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op10_redirect_equivalence": url_equivalence.SQL}
