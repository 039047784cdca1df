"""Queries of this subpackage: `QUERIES[name](spark, sf_dir)` and their DuckDB text."""

from __future__ import annotations

from hrsight.llm import align, decontaminate, id_files, lang_id, line_dedup, near_dup, packing, phrases, pii, quality_model, quality_rules, suffix_dedup, token_counts

QUERIES = {
    "op1_pii": pii.op1,
    "op2_suffix_dedup": suffix_dedup.op2,
    "op3_line_dedup": line_dedup.op3,
    "op4_id_files": id_files.op4,
    "op5_quality_model": quality_model.op5,
    "op6_quality_rules": quality_rules.op6,
    "op7_token_counts": token_counts.op7,
    "op8_decontamination": decontaminate.op8,
    "op9_minhash_near_dup": near_dup.op9,
    "op10_packing": packing.op10,
    "op11_tokenizer_alignment": align.op11,
    "op12_language_id": lang_id.op12,
    "op13_phrases": phrases.op13,
}

ORACLES: dict[str, str] = {"op13_phrases": phrases.ORACLE}
