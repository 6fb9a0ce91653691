"""Every registered query against its SQL in DuckDB, over sf0.001."""

import duckdb
import pytest

from vecframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return repr(list(map(shown, v))) if isinstance(v, (list, tuple)) else repr(v)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted([shown(r[names.index(c)]) for c in sorted(names)] for r in got.fetchall())
    assert sorted([shown(r[c]) for c in sorted(names)] for r in df.collect()) == want


def test_recall_of_half_the_lists(spark, sf):
    """The one query that SQL can't tell: k-means."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"ivf_recall"}
    got = [r.recall for r in registry.QUERIES["ivf_recall"](spark, sf).collect()]
    assert got and sum(got) / len(got) >= 0.9
