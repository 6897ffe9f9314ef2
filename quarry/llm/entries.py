"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, decontaminate, html_extract, lm_score, near_dups, neighbours, pieces, quality, sstable, suffix_dedup

QUERIES = {
    "op1_decontamination": decontaminate.decontamination_query,
    "op2_chat_format": chat_format.chat_query,
    "op3_near_dups": near_dups.near_query,
    "op4_pieces": pieces.pieces_query,
    "op5_quality": quality.quality_query,
    "op6_lm_score": lm_score.lm_query,
    "op7_html_extract": html_extract.html_query,
    "op8_neighbours": neighbours.neighbours_query,
    "op9_token_output": sstable.token_output_query,
    "op10_suffix_dedup": suffix_dedup.suffix_query,
}

ORACLE_SQL = {
    "op1_decontamination": decontaminate.SQL,
    "op2_chat_format": chat_format.SQL,
    "op8_neighbours": neighbours.SQL,
}
