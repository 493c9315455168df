"""Every query that has an SQL twin against DuckDB on the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    if hasattr(value, "as_integer_ratio") and not isinstance(value, bool):
        return float(value)
    return value


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=lambda r: tuple((v is not None, str(type(v)), v) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, duck, name):
    found = catalog.queries()[name](spark, SF)
    wanted = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in wanted.description]
    assert sorted(found.columns) == sorted(names)
    got, want = rows(found.columns, found.collect()), rows(names, wanted.fetchall())
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=2e-5) if all(v is not None for v in g) else _close(g, w)


def _close(g, w):
    return all(a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5) for a, b in zip(g, w, strict=True))


def test_every_query_is_registered_once():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
