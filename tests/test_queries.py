"""The registry is complete and its queries run on the smallest tables."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_every_check_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) > 150


@needs_data
def test_entry_has_a_row_per_threshold(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 9 and {r.t for r in rows} >= {0.3, 0.5, 0.7}


@needs_data
@pytest.mark.parametrize("name", ["e4_rank_and_cap", "f7_miss_buckets", "c12_cluster_span", "i14_dedupe_anchors", "h8_decide", "s2_class_stream"])
def test_queries_equal_their_check_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    got = E.queries()[name](spark, SF)
    want = con.execute(E.oracle_sql()[name])
    cols = sorted(got.columns)
    names = [d[0] for d in want.description]
    order = [names.index(c) for c in cols]
    assert sorted(map(repr, (tuple(r) for r in got.select(*cols).collect()))) == sorted(map(repr, (tuple(r[i] for i in order) for r in want.fetchall())))
