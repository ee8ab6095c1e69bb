"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from topicspace.llm.divergence import OP13_SQL, op13_source_divergence
from topicspace.llm.fill_middle import OP11_SQL, op11_fill_in_middle
from topicspace.llm.langid import op9_language_id
from topicspace.llm.merge_dropout import op8_merge_dropout
from topicspace.llm.mixing import op5_mix_sources
from topicspace.llm.pii import op3_pii_surrogates
from topicspace.llm.prefix_forest import op10_nearest_vectors
from topicspace.llm.quality import op7_quality_rules
from topicspace.llm.sharding import op1_shard_shuffle
from topicspace.llm.shingle_join import OP12_SQL, op12_shingle_join
from topicspace.llm.simhash import op2_simhash_near_dedup
from topicspace.llm.token_files import op4_token_files
from topicspace.llm.wrappers import op6_wrapper_extraction

_QUERIES = [op1_shard_shuffle, op2_simhash_near_dedup, op3_pii_surrogates,
            op4_token_files, op5_mix_sources, op6_wrapper_extraction, op7_quality_rules,
            op8_merge_dropout, op9_language_id, op10_nearest_vectors,
            op11_fill_in_middle, op12_shingle_join, op13_source_divergence]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    """SQL of the last three. The others have no equivalent in SQL (XXH64, CRC-32, seeded
    permutations, tokenizers, expectation-maximisation); tests/llm compares those with a
    brute-force version instead."""
    return {"op11_fill_in_middle": OP11_SQL, "op12_shingle_join": OP12_SQL,
            "op13_source_divergence": OP13_SQL}
