import os

import pytest

from millrace import queries

SF = "/root/testdata/sf0.001"


def rows(found):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in found), key=repr)


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the test data")
@pytest.mark.parametrize("name", sorted(queries.sql()))
def test_the_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    found = con.execute(queries.sql()[name])
    names = [d[0] for d in found.description]
    want = rows(found.fetchall())
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert rows(map(tuple, got.select(*names).collect())) == want
