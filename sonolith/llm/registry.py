"""Queries of the corpus operators, and their SQL twins."""

from sonolith.llm.decontaminate import op7_decontaminate
from sonolith.llm.embedding_dedup import OP10_SQL, op10_embedding_dedup
from sonolith.llm.html_text import op3_html_text
from sonolith.llm.langid import op6_language_id
from sonolith.llm.line_dedup import OP9_SQL, op9_line_dedup
from sonolith.llm.mixing import OP5_SQL, op5_weighted_mix
from sonolith.llm.secrets import OP1_SQL, op1_secret_scan
from sonolith.llm.simhash import op4_simhash_dedup
from sonolith.llm.token_shards import op2_token_shards
from sonolith.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_shards": op2_token_shards,
    "op3_html_text": op3_html_text,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_weighted_mix": op5_weighted_mix,
    "op6_language_id": op6_language_id,
    "op7_decontaminate": op7_decontaminate,
    "op8_toxicity": op8_toxicity,
    "op9_line_dedup": op9_line_dedup,
    "op10_embedding_dedup": op10_embedding_dedup,
}
ORACLES: dict[str, str] = {"op1_secret_scan": OP1_SQL, "op5_weighted_mix": OP5_SQL, "op9_line_dedup": OP9_SQL, "op10_embedding_dedup": OP10_SQL}
