"""Every query of the terrain operators against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

from tests.conftest import DATA
from terrasol.plans import registry

SF = f"{DATA}/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}") + 0.0
    return v


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_strips_cover_the_rows_of_a_larger_table(spark):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/sf0.01/{t}.parquet'")
    got = sorted(map(tuple, registry.queries()["split_strips_extent"](spark, f"{DATA}/sf0.01").select("strip", "row", "col", "nir").collect()), key=repr)
    want = sorted(c.sql(registry.oracle_sql()["split_strips_extent"]).fetchall(), key=repr)
    assert got == want and max(r[1] for r in got) == 147
