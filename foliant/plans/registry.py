"""How queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_SPARK = {"l": lambda c: F.col(c).cast("long"), "d": lambda c: F.round(F.col(c).cast("double"), 6), "s": lambda c: F.col(c).cast("string"), "b": lambda c: F.col(c).cast("boolean")}
_SQL = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}


def query(name: str, columns: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under ``name``. ``columns``: the result's, with types, as in "page_id:l ratio:d note:s"."""
    typed = [c.split(":") for c in columns.split()]

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*[_SPARK[t](c).alias(c) for c, t in typed])
        if sql is not None:
            ORACLE_SQL[name] = "SELECT " + ", ".join(f"{_SQL[t].format(c)} AS {c}" for c, t in typed) + f" FROM ({sql}) AS result"
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glyph_sql(source: str, id_col: str, widths: int = 4, name: str = "g") -> str:
    """CTEs that end in ``name``: the boxes of every character of a table's texts."""
    return f"""
      {name}0 AS (SELECT {id_col} AS page_id, string_split(text, chr(10)) AS a FROM {source} WHERE text IS NOT NULL),
      {name}1 AS (SELECT page_id, unnest(a) AS s, unnest(range(len(a))) AS raw_no FROM {name}0),
      {name}2 AS (SELECT page_id, s, coalesce(sum(greatest(1, CAST(ceil(length(s) / 80.0) AS BIGINT))) OVER (PARTITION BY page_id ORDER BY raw_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS head FROM {name}1),
      {name}3 AS (SELECT page_id, head, unnest(string_split(s, '')) AS ch, unnest(range(length(s))) AS p FROM {name}2),
      {name}4 AS (SELECT page_id, head + p // 80 AS line_no, p % 80 AS col_no, ch, unicode(ch) AS c FROM {name}3 WHERE ch NOT IN ('', ' ')),
      {name} AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY line_no, col_no) - 1 AS glyph_id, line_no, col_no, 12 * col_no AS x, 24 * line_no + 4 * (c % 3) AS y,
        8 + c % {widths} AS width, 16 - 4 * (c % 3) + CASE WHEN ch IN ('g', 'j', 'p', 'q', 'y') THEN 4 ELSE 0 END AS height FROM {name}4)"""
