"""The queries of this package and their SQL."""

from __future__ import annotations

from . import embedding_dedup, gif_media, line_dedup, near_dedup, packing, quality, sentencepiece_codec, sharding, sstable, toxicity


def queries() -> dict:
    return {
        "op1_toxicity": toxicity.query,
        "op2_near_dedup": near_dedup.query,
        "op3_sentencepiece": sentencepiece_codec.query,
        "op4_best_fit_packing": packing.query,
        "op5_sstable": sstable.query,
        "op6_vector_graph": embedding_dedup.query,
        "op7_quality": quality.query,
        "op8_jump_sharding": sharding.query,
        "op9_line_windows": line_dedup.query,
        "op10_gif": gif_media.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_vector_graph": embedding_dedup.SQL,
        "op8_jump_sharding": sharding.SQL,
        "op9_line_windows": line_dedup.SQL,
    }
