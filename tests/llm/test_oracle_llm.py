"""Corpus queries that have an SQL twin against DuckDB on the whole tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm import registry

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = registry.queries()[name](spark, SF)
    wanted = con.execute(registry.oracle_sql()[name])
    columns = sorted(d[0] for d in wanted.description)
    assert sorted(found.columns) == columns
    names = [d[0] for d in wanted.description]
    pick = lambda r, of: tuple(round(v, 9) if isinstance(v, float) else v for v in (r[of.index(c)] for c in columns))
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    got = sorted((pick(r, found.columns) for r in found.collect()), key=key)
    assert got == sorted((pick(r, names) for r in wanted.fetchall()), key=key)
