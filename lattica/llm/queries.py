"""The queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from lattica.llm.bpe_codec import op9_bpe_codec
from lattica.llm.chat_format import op3_chat_format
from lattica.llm.decontaminate import OP6_SQL, op6_decontaminate
from lattica.llm.exact_dedup import OP2_SQL, op2_exact_dedup
from lattica.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from lattica.llm.forest import op12_nearest
from lattica.llm.line_dedup import OP4_SQL, op4_line_dedup
from lattica.llm.near_dedup import op8_near_dedup
from lattica.llm.quality import op10_quality
from lattica.llm.sharding import op5_sharding, op5_sql
from lattica.llm.spelling import OP13_SQL, op13_spelling
from lattica.llm.token_store import op1_token_store
from lattica.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_line_dedup": op4_line_dedup,
    "op5_sharding": op5_sharding,
    "op6_decontaminate": op6_decontaminate,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_bpe_codec": op9_bpe_codec,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_nearest": op12_nearest,
    "op13_spelling": op13_spelling,
}
ORACLE_SQL = {"op2_exact_dedup": OP2_SQL, "op4_line_dedup": OP4_SQL, "op5_sharding": op5_sql(), "op6_decontaminate": OP6_SQL, "op11_fill_in_middle": OP11_SQL, "op13_spelling": OP13_SQL}
