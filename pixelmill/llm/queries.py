"""The registered queries of this subpackage, one per operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import backoff, bpe, decontaminate, exact, jaccard, lines, reshard, substrings, toxicity, urls

QUERIES = {
    "op1_ngram_jaccard": jaccard.query,
    "op2_suffix_dedup": substrings.query,
    "op3_exact_dedup": exact.query,
    "op4_url_filters": urls.query,
    "op5_toxicity": toxicity.query,
    "op6_bpe": bpe.query,
    "op7_lm_scoring": backoff.query,
    "op8_decontaminate": decontaminate.query,
    "op9_resharding": reshard.query,
    "op10_line_dedup": lines.query,
}

ORACLES = {
    "op3_exact_dedup": exact.ORACLE,
    "op4_url_filters": urls.ORACLE,
}
