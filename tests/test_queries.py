"""Every core query against its SQL in DuckDB; those without SQL must give rows, and the same ones when run again."""

import math

import duckdb
import pytest

from tidebook import plans  # noqa: F401
from tidebook.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = []
    for r in rows:
        vals = [float(v) if type(v).__name__ == "Decimal" else v for v in (r[i] for i in order)]
        out.append(tuple(None if isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v for v in vals))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    expected = duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(map(tuple, got.collect()), got.columns) == plain(expected.fetchall(), expected.columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows_and_the_same_again(spark, name):
    first, again = (QUERIES[name](spark, SF) for _ in range(2))
    rows = sorted(map(str, first.collect()))
    assert rows and rows == sorted(map(str, again.collect()))


def test_panel_covers_every_session(spark):
    got = QUERIES["h5_balanced_panel"](spark, SF).collect()
    sessions = {r["session_id"] for r in QUERIES["f22_window_descriptors"](spark, SF).collect()}
    assert len(sessions) > 1 and {r["session_id"] for r in got} == sessions
