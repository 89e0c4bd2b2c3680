"""Registered queries against their SQL, whole tables at the smallest scale."""

import duckdb
import pytest

import __spark_entry__
from foliant.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"j6_knn", "s4_knn_matrix", "j4_line_stab", "w7_gap_to_next", "w8_flags", "w1_word_gaps", "g5_cut_dist", "a11_cluster_count"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(set(catalog.ORACLE_SQL) - SLOW))
def test_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER).toArrow()
    want = duck.sql(catalog.ORACLE_SQL[name]).df()
    names = sorted(got.column_names)
    assert names == sorted(want.columns) and got.num_rows
    one = got.select(names).to_pandas().sort_values(names, ignore_index=True)
    other = want[names].sort_values(names, ignore_index=True)
    assert one.equals(other.astype(one.dtypes.to_dict()))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
