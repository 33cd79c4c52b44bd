"""The queries of the training-data operators and the SQL of those that SQL can express."""

from . import chat_format, collocations, hard_negatives, line_dedup, mixing, packing, quality_pu, quality_rules, secrets, simhash, suffix_dedup, topk, toxicity


def queries():
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_packing": packing.op2_packing,
        "op3_secrets": secrets.op3_secrets,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_simhash": simhash.op5_simhash,
        "op6_exact_topk": topk.op6_exact_topk,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_quality_pu": quality_pu.op9_quality_pu,
        "op10_mixing": mixing.op10_mixing,
        "op11_toxicity": toxicity.op11_toxicity,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_collocations": collocations.op13_collocations,
    }


def oracle_sql():
    return {
        "op4_chat_format": chat_format.OP4_SQL,
        "op6_exact_topk": topk.OP6_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
