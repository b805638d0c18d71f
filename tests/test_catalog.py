import duckdb
import pytest

import __spark_entry__ as entry
from vektorium.plans import catalog


def test_flagship(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["knn_l2", "knn_filtered_multi", "bm25_topk", "segment_stats_numeric", "sq8_search", "p2_found"])
def test_equals_sql(spark, sf, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    df = catalog.QUERIES[name](spark, sf)
    cur = con.execute(catalog.SQL[name])
    cols = [c[0] for c in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    assert sorted(df.columns) == sorted(cols)
    assert sorted(repr(tuple(r)) for r in df.select(*cols).collect()) == want
