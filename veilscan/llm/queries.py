"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from veilscan.llm import (
    byte_bpe,
    chat_snapshots,
    context_mixing,
    decontaminate,
    importance_resampling,
    jaccard_groups,
    license_scan,
    line_dedup,
    pu_quality,
    quality_rules,
    repeated_bytes,
    spelling_variants,
    token_files,
)

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_chat_snapshots": chat_snapshots.op2_chat_snapshots,
    "op3_pu_quality": pu_quality.op3_pu_quality,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_token_files": token_files.op5_token_files,
    "op6_jaccard_groups": jaccard_groups.op6_jaccard_groups,
    "op7_repeated_bytes": repeated_bytes.op7_repeated_bytes,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_context_mixing": context_mixing.op10_context_mixing,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op12_line_dedup": line_dedup.op12_line_dedup,
    "op13_spelling_variants": spelling_variants.op13_spelling_variants,
}

SQL = {
    "op2_chat_snapshots": chat_snapshots.SQL,
    "op4_quality_rules": quality_rules.SQL,
    "op6_jaccard_groups": jaccard_groups.SQL,
    "op7_repeated_bytes": repeated_bytes.SQL,
    "op11_importance_resampling": importance_resampling.SQL,
    "op12_line_dedup": line_dedup.SQL,
    "op13_spelling_variants": spelling_variants.SQL,
}
