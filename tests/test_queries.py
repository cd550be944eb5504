"""Every query on small tables; those with SQL against DuckDB, row by row."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pandas as pd
import pytest

from spliceflow.plans.registry import ORACLES, QUERIES

TABLES = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def results(spark, request):
    """Futures of the queries that were asked for; jobs of several queries share the cores."""
    asked = {item.callspec.params.get("name") for item in request.session.items if hasattr(item, "callspec")}
    pool = ThreadPoolExecutor(8)
    yield {name: pool.submit(lambda q: q(spark, TABLES).toPandas(), q) for name, q in QUERIES.items() if name in asked}
    pool.shutdown(cancel_futures=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("events", "embeddings", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{TABLES}/{name}.parquet'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = (tuple(None if pd.isna(v) else pd.Timestamp(v) if hasattr(v, "year") else v for v in r) for r in df.itertuples(index=False))
    return sorted(rows, key=lambda r: tuple((v is not None, v) if not isinstance(v, str) else (True, v) for v in r))


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(results, duck, name):
    got, expected = results[name].result(), duck.execute(ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert len(got) and comparable(got) == comparable(expected)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs(results, name):
    assert len(results[name].result())


def test_random_interleaving_of_whole_tracks(spark, duck):
    got = QUERIES["interleave_random"](spark, TABLES).toPandas()
    shortest = duck.execute("SELECT min(n) FROM (SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY o_orderstatus)").fetchone()[0]
    assert sorted(got["out_idx"]) == list(range(3 * shortest))
    assert all(sorted(x) == list(range(shortest)) for _, x in got.groupby("track")["idx"])
