"""From documents to packed sequences: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import decontaminate, packing, quality, secrets, simhash
from foliant.shared import materialise, remove, temporary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it is fitted on labelled rows of ``docs``."""
    return quality.accepted(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage lies, even with edits."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their texts and n_chars set anew."""
    return secrets.redact(docs, chars_col="n_chars")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in as few sequences as found."""
    return packing.pack(docs)


STAGES = [("quality classifier", keep_good), ("SimHash near-dedup", drop_near_copies), ("benchmark decontamination", drop_leaks), ("secret scans", redact_secrets), ("best-fit packing", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage is written once; what it made on the way, and what the stage before left, is deleted then."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        kept: list[str] = []
        with temporary(spark, keep=kept):
            docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
            kept += sorted({f.rpartition("/")[0] for f in docs.inputFiles()})
        if before is not None:
            remove(before)
        before = docs
    return docs
