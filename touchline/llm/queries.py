"""The registered queries of this folder and their checking SQL."""

from __future__ import annotations

from touchline.llm.byte_bpe import op8_byte_bpe
from touchline.llm.divergence import OP11_SQL, op11_source_divergence
from touchline.llm.extraction import op4_html_extraction
from touchline.llm.filter_audit import OP12_SQL, op12_filter_audit
from touchline.llm.line_dedup import op5_line_dedup
from touchline.llm.neighbours import op7_neighbours
from touchline.llm.packing import op1_packing
from touchline.llm.quality import OP2_SQL, op2_quality_rules
from touchline.llm.sentence_pieces import op13_sentence_pieces
from touchline.llm.simhash import op3_simhash
from touchline.llm.substring_dedup import op6_substring_dedup
from touchline.llm.token_counts import op9_token_counts
from touchline.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_simhash": op3_simhash,
    "op4_html_extraction": op4_html_extraction,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_neighbours": op7_neighbours,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_source_divergence": op11_source_divergence,
    "op12_filter_audit": op12_filter_audit,
    "op13_sentence_pieces": op13_sentence_pieces,
}
ORACLE: dict[str, str] = {
    "op2_quality_rules": OP2_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_filter_audit": OP12_SQL,
}
