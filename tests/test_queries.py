"""Every query with SQL is held against DuckDB on the smallest tables."""

import os
import sys

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    text = lambda v: "-" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_as_sql(spark, db, name):
    ours, theirs = registry.QUERIES[name](spark, SF).toPandas(), db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_optimal_assignments_cost_no_more_than_greedy_ones(spark):
    costs = registry.QUERIES["assignment_costs"](spark, SF).toPandas()
    assert len(costs) and (costs["cost"] <= costs["greedy_cost"] + 1e-6).all() and (costs["n_assigned"] <= costs[["n_tracks", "n_plots"]].min(axis=1)).all()


def test_assignments_are_partial_matchings(spark):
    best = registry.QUERIES["global_assign"](spark, SF).toPandas()
    assert not best.duplicated(["frame_idx", "track_id"]).any() and not best.duplicated(["frame_idx", "meas_id"]).any()
