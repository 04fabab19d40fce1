"""A part of the registered queries against their SQL on the smallest tables; ``compare.py`` runs all."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests.compare import check, duck

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = (
    "station_id", "pivot_wide", "clean_hourly", "gap_counts", "all_features", "daily_station", "monthly_state",
    "explode_parallel_arrays", "unwrap_envelope", "pull_plan", "validate_requests", "live_coverage",
    "metrics_by_group", "stream_hourly_mean",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_its_sql(spark, con, name):
    line = check(spark, con, SF_DIR, name, entry.queries()[name], entry.oracle_sql()[name])
    assert ": ok" in line, line


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
