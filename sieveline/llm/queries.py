"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from sieveline.llm import decontaminate, embedding, language, linededup, mixing, pii, quality, secret_scan, simhash, substring


def queries():
    return {
        "op1_mix": mixing.op1_mix,
        "op2_language": language.op2_language,
        "op3_quality": quality.op3_quality,
        "op4_lines": linededup.op4_lines,
        "op5_pii": pii.op5_pii,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_substring": substring.op7_substring,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_simhash": simhash.op9_simhash,
        "op10_embedding": embedding.op10_embedding,
    }


def oracle_sql():
    return {"op1_mix": mixing.OP1_SQL, "op4_lines": linededup.OP4_SQL, "op5_pii": pii.OP5_SQL, "op6_secrets": secret_scan.OP6_SQL, "op7_substring": substring.OP7_SQL, "op8_decontaminate": decontaminate.OP8_SQL}
