"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, licenses, lines, near, packing, pieces, pii, quality, sharding, topk


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_personal_data": pii.op2_personal_data,
        "op3_license_scan": licenses.op3_license_scan,
        "op4_line_dedup": lines.op4_line_dedup,
        "op5_ngram_jaccard": near.op5_ngram_jaccard,
        "op6_exact_top_k": topk.op6_exact_top_k,
        "op7_packing": packing.op7_packing,
        "op8_sharding": sharding.op8_sharding,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_ann": ann.op10_ann,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_license_scan": licenses.OP3_SQL, "op6_exact_top_k": topk.OP6_SQL}
