"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_MADE: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, on one machine only, a folder of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    for made in _MADE:
        made.append(path)
    return path


@contextmanager
def temporary(spark: SparkSession, *, keep: list[str] | None = None) -> Iterator[None]:
    """Delete at the end what was written under new paths inside, but for the folders that ``keep`` then names.

    Results that read these tables must have been written or collected by then.
    """
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE[:] = [x for x in _MADE if x is not made]
        kept = {k.rstrip("/").rpartition("/")[2] for k in keep or ()}
        for path in made:
            if path.rpartition("/")[2] not in kept:
                _delete(spark, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet and read it back: the lineage is cut, and what a lost executor held can be read again."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merging(df: DataFrame) -> DataFrame:
    """``df``, which grows with the input, for a join: by merge, so that it is never broadcast and takes no memory of the driver.

    Left alone, Spark goes by the size of Parquet files, which may be a tenth of what their rows take in a hash table.
    """
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Let the driver's JVM collect its garbage, so that Spark deletes the shuffle files of jobs whose results are written."""
    spark._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete the files behind a table of ``materialise`` that no later step reads."""
    for name in df.inputFiles()[:1]:
        _delete(df.sparkSession, name.rpartition("/")[0])
