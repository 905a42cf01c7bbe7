"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import corpus_pipeline
from ledgerloom.llm import alignment, bpe, centroids, chat_format, exact_dedup, html_extract, line_dedup, near_dedup, packing, pii, quality_rules, simhash, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_minhash_near_dedup": near_dedup.op4_minhash_near_dedup,
        "op5_bpe": bpe.op5_bpe,
        "op6_html_extract": html_extract.op6_html_extract,
        "op7_chat_format": chat_format.op7_chat_format,
        "op8_pii": pii.op8_pii,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
        "op13_centroid_clustering": centroids.op13_centroid_clustering,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat_format": chat_format.OP7_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL, "op13_centroid_clustering": centroids.OP13_SQL}
