"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from voxelspring.llm import alignment, bpe, chat, lm, media, merkle, mixing, neardup, neighbours, packing, substrings, toxicity, urls

QUERIES = {
    "op1_best_fit_packing": packing.query,
    "op2_lm_scoring": lm.query,
    "op3_exact_topk": neighbours.query,
    "op4_media_columns": media.query,
    "op5_toxicity": toxicity.query,
    "op6_url_filter": urls.query,
    "op7_minhash_dedup": neardup.query,
    "op8_chat_tool_linking": chat.query,
    "op9_substring_dedup": substrings.query,
    "op10_bpe_codec": bpe.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_merkle_manifest": merkle.query,
    "op13_source_mixing": mixing.query,
    # what SQL can express of op4, op6 and op13
    "media_payloads": media.payload_query,
    "url_rules": urls.rules_query,
    "mixing_targets": mixing.targets_query,
}
ORACLES: dict[str, str] = {
    "op3_exact_topk": neighbours.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "media_payloads": media.PAYLOAD_ORACLE,
    "url_rules": urls.RULES_ORACLE,
    "mixing_targets": mixing.TARGETS_ORACLE,
}
