"""Every registered query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

from touchline.plans import registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLE[name])
    expected = canonical([c[0] for c in cur.description], cur.fetchall())
    found = canonical(df.columns, [tuple(r) for r in df.collect()])
    assert found == expected


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
