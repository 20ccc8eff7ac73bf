"""Every registered query of the catalogue against its SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

import halyard.index_queries  # noqa: F401  registers more queries
import halyard.scalar_queries  # noqa: F401
import halyard.workflow_queries  # noqa: F401
from halyard.queries import ORACLES, QUERIES


def plain(v):
    return (round(v, 6) if abs(v) < 1e6 else float(f"{v:.12g}")) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for f in glob.glob(f"{tiny}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    df = QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows or name == "filter_format_mov"
    if name not in ORACLES:
        return
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[k]) for k in at) for r in found.fetchall()), key=repr)


def test_trash_items_agree_on_odd_events(spark, tmp_path):
    """Event 0 has a time of 0 whatever its type; types that are null or empty are no names."""
    rows = [(0, "click"), (1, None), (2, ""), (3, "view"), (4, "error"), (5, "signup"), (-3, "view"), (None, "click")]
    spark.createDataFrame(rows, "event_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["trash_items"](spark, str(tmp_path)).select("id", "name", "deleted_at_ms", "kind").collect()), key=repr)
    assert got == sorted(con.execute(f"SELECT id, name, deleted_at_ms, kind FROM ({ORACLES['trash_items']})").fetchall(), key=repr)
    now = 1_706_659_200_000
    assert {r[0]: r[1:3] for r in got if r[0] in ("0", "1", "2", "4")} == {"0": ("click", now), "1": ("IMG", 1), "2": ("IMG", 2), "4": ("error", now)}
