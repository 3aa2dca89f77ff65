import os

import pytest

from millrace.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_the_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(queries.SQL[name])
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall(), key=repr)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=repr) == want
