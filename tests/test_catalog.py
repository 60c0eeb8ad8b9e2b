"""Every catalogue query against its DuckDB SQL."""

import duckdb
import pytest

from loomgraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if x != x else x
    return tuple(map(plain, x)) if isinstance(x, list) else x


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = sorted((tuple(plain(row[c]) for c in sorted(df.columns)) for row in df.collect()), key=str)
    relation = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    assert got == sorted((tuple(plain(row[i]) for i in at) for row in relation.fetchall()), key=str)
