"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, chat_format, line_dedup, minhash, packing, pieces, quality, simhash, sstable, url_filter


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_minhash": minhash.op2_minhash,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_chat_format": chat_format.op4_chat_format,
        "op5_token_shards": sstable.op5_token_shards,
        "op6_url_filter": url_filter.op6_url_filter,
        "op7_nearest": ann.op7_nearest,
        "op8_simhash": simhash.op8_simhash,
        "op9_sentencepiece": pieces.op9_sentencepiece,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op4_chat_format": chat_format.SQL,
        "op6_url_filter": url_filter.SQL,
    }
