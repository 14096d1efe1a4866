"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .decontam import OP6_SQL, op6_benchmark_decontamination
from .embeddings import OP7_SQL, op7_embedding_near_dedup
from .langid import op8_language_id
from .lines import op9_line_dedup
from .mixing import op10_mixing
from .quality import op1_quality_classifier
from .simhash import op4_simhash_near_dedup
from .substring import OP2_SQL, op2_substring_dedup
from .tokenids import op5_token_ids
from .toxicity import op3_toxicity

QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_token_ids": op5_token_ids,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    "op2_substring_dedup": OP2_SQL,
    "op6_benchmark_decontamination": OP6_SQL,
    "op7_embedding_near_dedup": OP7_SQL,
}
