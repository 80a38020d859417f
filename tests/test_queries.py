"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from loomspan.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows_as_sql(spark, db, name):
    got = registry.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(registry.SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert sorted(tuple(map(shown, r)) for r in got.select(*cols).collect()) == sorted(tuple(shown(r[i]) for i in at) for r in want.fetchall())


def test_queries_without_sql_are_few():
    assert set(registry.QUERIES) - set(registry.SQL) == {"hnsw_layer_hist", "ann_graph_topk", "quote_anywhere"}
