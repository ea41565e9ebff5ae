"""The operators' registered queries and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from .decontaminate import OP4_SQL, op4_benchmark_decontamination
from .jaccard import OP9_SQL, op9_ngram_jaccard_join
from .langid import op7_language_id
from .license import op10_license_scan
from .lm import op2_lm_scoring
from .mixing import op3_mix_sources
from .neardup import OP5_SQL, op5_embedding_near_dedup
from .quality import op8_quality_classifier
from .tokencount import op1_token_counts
from .toxicity import op6_toxicity

QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_mix_sources": op3_mix_sources,
    "op4_benchmark_decontamination": op4_benchmark_decontamination,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_language_id": op7_language_id,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_license_scan": op10_license_scan,
}

ORACLE_SQL: dict[str, str] = {
    "op4_benchmark_decontamination": OP4_SQL,
    "op5_embedding_near_dedup": OP5_SQL,
    "op9_ngram_jaccard_join": OP9_SQL,
}
