"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from . import chat, decontaminate, divergence, huffman, jaccard, licences, negatives, packing, pii, secret_scan, topk, toxicity, warc

QUERIES = {
    "op1_licences": licences.op1_licences,
    "op2_packing": packing.op2_packing,
    "op3_token_output": huffman.op3_token_output,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_decontamination": decontaminate.op5_decontamination,
    "op6_warc": warc.op6_warc,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_pii": pii.op8_pii,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_exact_topk": topk.op10_exact_topk,
    "op11_chat_formatting": chat.op11_chat_formatting,
    "op12_source_divergence": divergence.op12_source_divergence,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}
ORACLE_SQL: dict[str, str] = {
    "op1_licences": licences.sql(), "op6_warc": warc.OP6_SQL, "op9_jaccard_join": jaccard.OP9_SQL, "op10_exact_topk": topk.OP10_SQL,
    "op11_chat_formatting": chat.OP11_SQL, "op12_source_divergence": divergence.OP12_SQL, "op13_hard_negatives": negatives.OP13_SQL,
}
