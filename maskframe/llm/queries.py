"""The queries of the pipeline operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, language, near_dedup, overlap_join, quality, substring_dedup, suffix_dedup, url_filter, vector_codes, warc

QUERIES = {
    f.__name__: f
    for f in (
        quality.op1_quality,
        warc.op2_warc,
        url_filter.op3_url_filter,
        decontaminate.op4_decontaminate,
        chat.op5_chat_format,
        bpe.op6_bpe,
        substring_dedup.op7_substring_dedup,
        near_dedup.op8_near_dedup,
        exact_dedup.op9_exact_dedup,
        language.op10_language,
        vector_codes.op11_vector_codes,
        overlap_join.op12_overlap_join,
        suffix_dedup.op13_suffix_dedup,
    )
}

ORACLE_SQL = {
    "op2_warc": warc.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_overlap_join": overlap_join.ORACLE_SQL,
}
