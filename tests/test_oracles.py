"""Every query that SQL can express against DuckDB on the same files."""

import math

import duckdb
import pytest

from cyclora.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "float32", "float64"):
        return f"{float(v) + 0.0:.10g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(name, spark, sf, duck):
    df = catalog.QUERIES[name](spark, sf)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in order) for r in want.fetchall())


#: Of many rounds each; their own tests hold them to slow versions.
ROUNDS = {"graph_communities", "density_clusters", "graph_small_world"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES) - ROUNDS))
def test_reruns_agree(name, spark, sf):
    """Others are held to models in test_models.py; here, that there are rows, and that they come again."""
    one, two = (sorted(map(str, catalog.QUERIES[name](spark, sf).collect())) for _ in range(2))
    assert one == two and one


@pytest.mark.parametrize("name", sorted(ROUNDS))
def test_queries_of_many_rounds_have_rows(name, spark, sf):
    assert catalog.QUERIES[name](spark, sf).count()
