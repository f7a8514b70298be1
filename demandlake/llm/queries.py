"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlake.llm.chat_format import op12_part_visitor_chat_format
from demandlake.llm.cross_tokenizer import op13_perfect_hash_alignment
from demandlake.llm.decontamination import op5_template_decontamination
from demandlake.llm.language_model import op6_hashed_maxent_scores
from demandlake.llm.matrices import op10_best_fit_matrix
from demandlake.llm.near_dedup import op7_setsketch_near_dedup
from demandlake.llm.packing import op4_column_generation_packing
from demandlake.llm.quality_rules import op8_line_frequency_quality
from demandlake.llm.secrets import op9_blob_ledger_secrets
from demandlake.llm.sharding import op3_rendezvous_sharding
from demandlake.llm.substring_dedup import op2_fixed_block_substrings
from demandlake.llm.suffix_dedup import op1_suffix_array_dedup
from demandlake.llm.whitening import op11_cholesky_jacobi_whitening

QUERIES = (
    op1_suffix_array_dedup,
    op2_fixed_block_substrings,
    op3_rendezvous_sharding,
    op4_column_generation_packing,
    op5_template_decontamination,
    op6_hashed_maxent_scores,
    op7_setsketch_near_dedup,
    op8_line_frequency_quality,
    op9_blob_ledger_secrets,
    op10_best_fit_matrix,
    op11_cholesky_jacobi_whitening,
    op12_part_visitor_chat_format,
    op13_perfect_hash_alignment,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {}
