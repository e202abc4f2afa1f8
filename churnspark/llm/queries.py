"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from churnspark.llm import (alignment, bpe, chat_format, fingerprints, jaccard_join, licenses, line_dedup, packing,
                            quality_rules, resampling, ring, secrets, token_counts)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_secret_scan": secrets.query,
    "op3_license_scan": licenses.query,
    "op4_bpe": bpe.query,
    "op5_packing": packing.query,
    "op6_jaccard_join": jaccard_join.query,
    "op7_quality_rules": quality_rules.query,
    "op8_token_counts": token_counts.query,
    "op9_fingerprints": fingerprints.query,
    "op10_chat_format": chat_format.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_importance_resampling": resampling.query,
    "op13_ring_sharding": ring.query,
}

ORACLES = {
    "op7_quality_rules": quality_rules.ORACLE,
    "op10_chat_format": chat_format.ORACLE,
}
