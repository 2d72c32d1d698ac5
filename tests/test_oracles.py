"""Every registered query with SQL gives DuckDB's rows at sf0.001."""

import os

import duckdb
import pytest

from canopy.plans import queries as registry
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    clean = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) or hasattr(v, "dtype") and v.dtype.kind == "f" else str(v)
    return sorted((tuple(clean(v) for v in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), duck.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
