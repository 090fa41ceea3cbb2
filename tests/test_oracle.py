"""Every registered query of the library against its SQL in DuckDB, on a small table."""

import duckdb
import pytest

import strandline.plans.files
import strandline.plans.reports
import strandline.plans.variants  # noqa: F401
from strandline.plans.registry import QUERIES, SQL


def normal(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        if frame[c].dtype.kind == "f":
            frame[c] = frame[c].round(9)
    return frame.astype(object).where(frame.notna(), None).map(lambda v: v if v is None or isinstance(v, (str, bool)) else float(v)).sort_values(list(frame.columns), key=lambda s: s.map(str)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, small_dir, name):
    db = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {name_} AS SELECT * FROM '{small_dir}/{name_}.parquet/*.parquet'")
    wanted, found = db.sql(SQL[name]).df(), QUERIES[name](spark, small_dir).toPandas()
    assert sorted(wanted.columns) == sorted(found.columns)
    assert normal(found).equals(normal(wanted))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, small_dir, name):
    assert len(QUERIES[name](spark, small_dir).toPandas())
