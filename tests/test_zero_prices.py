"""Bars whose prices are zero: queries agree with their SQL, where a division by zero is infinite or NaN and not null, and logs of zero are infinite."""

import duckdb
import pytest

from tidebar import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
NAMES = [
    "m9_liquidity",
    "a7_previous_levels",
    "b10_costs",
    "i11_momentum",
    "i21_volatility",
    "l1_forward_returns",
    "v13_contributions",
    "v14_ablation",
    "v13_tree_contributions",
]  # each differed from its SQL, or failed, where a price is zero


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events of which, from a day on, every 97th and a type's of six hours are worth nothing; a shorter table for the one whose SQL recurs from bar to bar."""
    folder, con = tmp_path_factory.mktemp("zeros"), duckdb.connect()
    for sf in ("sf0.001", "sf0.01"):
        (folder / sf).mkdir()
        con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN ts >= TIMESTAMP '2024-01-20' AND (event_id % 97 = 0 OR event_type = 'view' AND ts < TIMESTAMP '2024-01-20 06:00:00') THEN 0.0 ELSE value END AS value)
            FROM '/root/testdata/{sf}/events.parquet') TO '{folder / sf}/events.parquet' (FORMAT parquet)""")
    return folder


def exact(v):
    """NaN and null aren't the same here."""
    return "NaN" if v != v else v.replace(tzinfo=None) if hasattr(v, "replace") and hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql_at_zero(spark, zeros, name):
    folder, con = zeros / ("sf0.001" if name == "m9_liquidity" else "sf0.01"), duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.sql(ORACLES[name]).select(*(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted((tuple(map(exact, r)) for r in got), key=str) == sorted((tuple(map(exact, r)) for r in want), key=str)
