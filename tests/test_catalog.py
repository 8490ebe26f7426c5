import os

import pytest

D = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", ["bm25_batch_search", "cosine_batch", "retrieve_pipeline", "chunk_chars", "crawl_bfs", "entity_resolve", "stream_query_log", "build_context"])
def test_query_equals_its_sql(spark, name):
    import duckdb

    import __spark_entry__

    got = __spark_entry__.queries()[name](spark, D)
    con = duckdb.connect()
    for f in os.listdir(D):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{D}/{f}'")
    want = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
