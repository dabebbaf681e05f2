"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from tesselark.llm.chat import OP10_SQL, op10_chat_formatting
from tesselark.llm.cotraining import op2_quality_classifier
from tesselark.llm.decontaminate import OP4_SQL, op4_decontamination
from tesselark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tesselark.llm.line_dedup import OP6_SQL, op6_line_dedup
from tesselark.llm.ngram_join import OP5_SQL, op5_ngram_join
from tesselark.llm.packing import op1_packing
from tesselark.llm.pii import op8_pii
from tesselark.llm.quality_rules import op9_quality_rules
from tesselark.llm.sharding import op3_sharding
from tesselark.llm.token_counts import op7_token_counts
from tesselark.llm.turn_repair import OP13_SQL, op13_turn_repair
from tesselark.llm.url_filter import OP12_SQL, op12_url_filter

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_sharding": op3_sharding,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_counts": op7_token_counts,
    "op8_pii": op8_pii,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_url_filter": op12_url_filter,
    "op13_turn_repair": op13_turn_repair,
}
SQL: dict[str, str] = {
    "op4_decontamination": OP4_SQL,
    "op5_ngram_join": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_url_filter": OP12_SQL,
    "op13_turn_repair": OP13_SQL,
}
