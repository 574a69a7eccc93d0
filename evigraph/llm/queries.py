"""The queries of this subpackage and the SQL statements that state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigraph.llm import (
    ball_search, chat_format, decontamination, html_wrappers, language_id, packing, prefix_trie,
    quality_classifier, quality_rules, sharding, simhash, structure_repair, suffix_dedup,
)
from evigraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.scored(table(spark, sf_dir, "documents"),
                                     table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op5_html_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.main_texts(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"))


def op8_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.rotations(table(spark, sf_dir, "conversations"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predicted(table(spark, sf_dir, "documents"))


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents"), host="source")


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.nodes(table(spark, sf_dir, "conversations"))


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return structure_repair.audited(structure_repair.damaged(turns), turns)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (
        op1_quality, op2_sharding, op3_simhash, op4_packing, op5_html_wrappers, op6_decontamination,
        op7_suffix_dedup, op8_chat_rotation, op9_language_id,
        op10_line_frequency, op11_ball_tree, op12_prefix_trie,
        op13_structure_repair)}


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_rotation": chat_format.SQL, "op11_ball_tree": ball_search.SQL,
            "op12_prefix_trie": prefix_trie.SQL,
            "op13_structure_repair": structure_repair.SQL}
