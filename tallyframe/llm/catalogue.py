"""The subpackage's queries, and SQL for those that SQL can express."""

from tallyframe.llm import ann, bpe, langid, linededup, media, neardup, packing, sharding, tokencounts, toxicity

QUERIES = {
    "op1_near_dedup": neardup.op1_near_dedup,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_packing": packing.op4_packing,
    "op5_sharding": sharding.op5_sharding,
    "op6_byte_bpe": bpe.op6_byte_bpe,
    "op7_language_id": langid.op7_language_id,
    "op8_line_dedup": linededup.op8_line_dedup,
    "op9_nearest": ann.op9_nearest,
    "op10_media_columns": media.op10_media_columns,
}

ORACLES: dict[str, str] = {
    "op2_token_counts": tokencounts.OP2_SQL,
    "op8_line_dedup": linededup.OP8_SQL,
}
