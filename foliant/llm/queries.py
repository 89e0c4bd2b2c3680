"""The registered queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.sharding import ORACLE as SHARDS_SQL
from foliant.llm.topk import ORACLE as TOP_K_SQL
from foliant.shared import new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.simhash import hex64, near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", hex64(F.col("fp")[0]).alias("fingerprint"), "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.repeats import remove_repeats

    return remove_repeats(_table(spark, sf_dir, "documents"))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.topk import top_k

    return top_k(_table(spark, sf_dir, "embeddings"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.quality import classify

    return classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as read back from the committed shards."""
    from foliant.llm.sharding import shard_documents

    shards = shard_documents(_table(spark, sf_dir, "documents"), new_path(spark, "shards")).read()
    text = F.coalesce("text", F.lit(""))
    return shards.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"), "lang", "source", "n_chars")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.token_shards import write_shards

    return write_shards(_table(spark, sf_dir, "documents"), new_path(spark, "token-shards"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from foliant.llm.secrets import find_secrets

    return find_secrets(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_best_fit_packing, op3_simhash, op4_suffix_dedup, op5_top_k, op6_quality, op7_sharding, op8_token_shards, op9_token_counts, op10_secret_scan)}
ORACLE_SQL: dict[str, str] = {"op5_top_k": TOP_K_SQL, "op7_sharding": SHARDS_SQL}
