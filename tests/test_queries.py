"""Every registered query with SQL against DuckDB, and the shape of the rest."""

import os

import duckdb
import pytest

from ledgerline import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.sql(f"create view {f.removesuffix('.parquet')} as from '{sf_dir}/{f}'")
    return c


def canon(rows):
    def text(v):
        if v is None or v != v:
            return "NULL"
        return f"{v:.6f}".rstrip("0").rstrip(".") if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    cols = sorted(got.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert canon([tuple(r[c] for c in cols) for r in got.collect()]) == canon(want.query("w", f"select {quoted} from w").fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0
