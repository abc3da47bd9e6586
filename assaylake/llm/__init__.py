"""Operators for training-data pipelines, their queries and SQL twins.

Nothing else in the library imports this subpackage.
"""

from __future__ import annotations

from . import (clustering, conversations, language, lines, mixing, packing, perplexity_rules, quality_model, simhash,
               token_counts, topk, toxicity, units)


def queries() -> dict:
    return {
        "op1_quality": quality_model.op1_quality,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_topk": topk.op4_topk,
        "op5_simhash": simhash.op5_simhash,
        "op6_substring_dedup": units.op6_substring_dedup,
        "op7_language": language.op7_language,
        "op8_packing": packing.op8_packing,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_quality_rules": perplexity_rules.op10_quality_rules,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_clustering": clustering.op12_clustering,
        "op13_conversations": conversations.op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup": lines.OP2_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op4_topk": topk.OP4_SQL,
        "op12_clustering": clustering.OP12_SQL,
    }
