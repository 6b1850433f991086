"""The queries of this subpackage, by name, and the SQL of those that SQL can express."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from maskwright.llm import (
    byte_bpe,
    divergence,
    exact_dedup,
    language_id,
    lm_scoring,
    mixing,
    near_dedup,
    prefix_trie,
    repetition,
    sharding,
    token_files,
    toxicity,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition": repetition.query,
    "op2_mixing": mixing.query,
    "op3_near_dedup": near_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_sharding": sharding.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_token_files": token_files.query,
    "op8_language_id": language_id.query,
    "op9_url_filter": url_filter.query,
    "op10_byte_bpe": byte_bpe.query,
    "op11_divergence": divergence.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_lm_scoring": lm_scoring.query,
}

SQL = {"op5_sharding": sharding.SQL, "op6_exact_dedup": exact_dedup.SQL, "op9_url_filter": url_filter.SQL, "op11_divergence": divergence.SQL, "op12_prefix_trie": prefix_trie.SQL}
