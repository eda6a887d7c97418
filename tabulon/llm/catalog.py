"""Registered queries of the training-data operators and the DuckDB twins of those that SQL can express."""

from __future__ import annotations

from tabulon.llm.bpe import op9_bpe
from tabulon.llm.chat import OP3_SQL, op3_chat_format
from tabulon.llm.decontaminate import op7_decontaminate
from tabulon.llm.html import op1_html_extract
from tabulon.llm.pieces import op13_pieces
from tabulon.llm.pii import op8_pii_spans
from tabulon.llm.quality import op4_quality
from tabulon.llm.repeats import op6_repeats
from tabulon.llm.secrets import op10_secrets
from tabulon.llm.simhash import op2_simhash
from tabulon.llm.urls import op5_url_filter
from tabulon.llm.variants import OP12_SQL, op12_variants
from tabulon.llm.whiten import op11_whiten

QUERIES: dict = {
    "op1_html_extract": op1_html_extract,
    "op2_simhash": op2_simhash,
    "op3_chat_format": op3_chat_format,
    "op4_quality": op4_quality,
    "op5_url_filter": op5_url_filter,
    "op6_repeats": op6_repeats,
    "op7_decontaminate": op7_decontaminate,
    "op8_pii_spans": op8_pii_spans,
    "op9_bpe": op9_bpe,
    "op10_secrets": op10_secrets,
    "op11_whiten": op11_whiten,
    "op12_variants": op12_variants,
    "op13_pieces": op13_pieces,
}

ORACLE_SQL: dict = {"op3_chat_format": OP3_SQL, "op12_variants": OP12_SQL}
