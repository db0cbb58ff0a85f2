"""The ten operators' queries and their SQL."""

from __future__ import annotations

from tidemark.llm import line_dedup, url_filter
from tidemark.llm.bpe import op5_byte_bpe
from tidemark.llm.decontam import op2_template_decontamination
from tidemark.llm.html import op1_html_extraction
from tidemark.llm.media import op8_media_columns
from tidemark.llm.near_dup import op9_minhash_near_dedup
from tidemark.llm.suffix import op6_suffix_dedup
from tidemark.llm.toxicity import op4_toxicity_chain
from tidemark.llm.warc import op10_warc_writer

_ALL = (op1_html_extraction, op2_template_decontamination, url_filter.op3_url_reputation, op4_toxicity_chain, op5_byte_bpe, op6_suffix_dedup, line_dedup.op7_line_dedup, op8_media_columns, op9_minhash_near_dedup, op10_warc_writer)
QUERIES = {f.__name__: f for f in _ALL}
ORACLE_SQL: dict[str, str] = {"op3_url_reputation": url_filter.ORACLE, "op7_line_dedup": line_dedup.ORACLE}
