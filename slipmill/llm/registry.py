"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from slipmill.llm import decontaminate, langid, merkle, mixing, neardup, preference, repair, sharding, substrings, tokens, topk, transport, warc


def queries() -> dict:
    found = {
        "op1_language_id": langid.op1_language_id,
        "op2_substring_dedup": substrings.op2_substring_dedup,
        "op3_token_counts": tokens.op3_token_counts,
        "op4_shard": sharding.op4_shard,
        "op5_transport_stream": transport.op5_transport_stream,
        "op6_preference_format": preference.op6_preference_format,
        "op7_mix_sources": mixing.op7_mix_sources,
        "op8_near_duplicates": neardup.op8_near_duplicates,
        "op9_capture_index": warc.op9_capture_index,
        "op10_decontaminate": decontaminate.op10_decontaminate,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_exact_topk": topk.op12_exact_topk,
        "op13_repair_conversations": repair.op13_repair_conversations,
    }

    def pipeline(spark, sf_dir):
        import corpus_pipeline

        return corpus_pipeline.run(spark, sf_dir)

    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_preference_format": preference.SQL,
        "op7_mix_sources": mixing.SQL,
        "op9_capture_index": warc.SQL,
        "op10_decontaminate": decontaminate.SQL,
        "op11_merkle_manifest": merkle.SQL,
        "op12_exact_topk": topk.SQL,
    }
