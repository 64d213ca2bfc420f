"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from voltlake.llm import jaccard, langid, neardup_vectors, neighbours, packing, pieces, quality, substrings, toolcalls, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.op1,
        "op2_tool_calls": toolcalls.op2,
        "op3_quality": quality.op3,
        "op4_embedding_neardup": neardup_vectors.op4,
        "op5_suffix_dedup": substrings.op5,
        "op6_pieces": pieces.op6,
        "op7_language_id": langid.op7,
        "op8_neighbours": neighbours.op8,
        "op9_jaccard_join": jaccard.op9,
        "op10_best_fit_packing": packing.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_tool_calls": toolcalls.OP2_SQL}
