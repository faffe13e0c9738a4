"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_topk, op2_language, op3_toxicity, op4_neardup, op5_sharding, op6_bpe, op7_suffixes, op8_embeddings, op9_lines, op10_mixing, stages


def queries() -> dict:
    return {
        "op1_topk_search": op1_topk.op1_topk_search,
        "op2_language_id": op2_language.op2_language_id,
        "op3_toxicity": op3_toxicity.op3_toxicity,
        "op4_minhash_dedup": op4_neardup.op4_minhash_dedup,
        "op5_shard": op5_sharding.op5_shard,
        "op6_bpe": op6_bpe.op6_bpe,
        "op7_repeated_strings": op7_suffixes.op7_repeated_strings,
        "op8_embedding_dedup": op8_embeddings.op8_embedding_dedup,
        "op9_line_dedup": op9_lines.op9_line_dedup,
        "op10_mix_sources": op10_mixing.op10_mix_sources,
        "pipeline": stages.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": op1_topk.SQL, "op8_embedding_dedup": op8_embeddings.SQL, "op9_line_dedup": op9_lines.SQL, "op10_mix_sources": op10_mixing.SQL}
