"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from . import audit, bestfit, bpe, chat_tools, embeddings, lloyd, packing, quality, sharding, simhash, substring, token_counts, warc


def queries() -> dict:
    return {
        "op1_tool_call_links": chat_tools.op1_tool_call_links,
        "op2_cached_token_counts": token_counts.op2_cached_token_counts,
        "op3_length_buckets": packing.op3_length_buckets,
        "op4_simhash_components": simhash.op4_simhash_components,
        "op5_adaptive_quality": quality.op5_adaptive_quality,
        "op6_warc_derivatives": warc.op6_warc_derivatives,
        "op7_shared_passages": substring.op7_shared_passages,
        "op8_multi_index": embeddings.op8_multi_index,
        "op9_feistel_shards": sharding.op9_feistel_shards,
        "op10_bpe_round_trip": bpe.op10_bpe_round_trip,
        "op11_filter_interactions": audit.op11_filter_interactions,
        "op12_best_fit_sequences": bestfit.op12_best_fit_sequences,
        "op13_delta_lloyd": lloyd.op13_delta_lloyd,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_adaptive_quality": quality.OP5_SQL, "op11_filter_interactions": audit.OP11_SQL, "op13_delta_lloyd": lloyd.OP13_SQL}
