"""Queries on tables in which one key holds a third of the rows, and on shuffled input."""

import os

import check
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fleetlens.plans.registry import Tables

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
SQLS = entry.oracle_sql()
NAMES = [
    "c01_latest_in_band", "c02_band_compare", "c06_recent_history", "c07_daily_high_water", "c08_growth_report",
    "c09_month_end_series", "c10_container_usage", "c11_container_alerts", "m01_metric_snapshot", "m03_lag_panel",
    "m05_metric_panel", "m06_counter_deltas", "m09_gap_check", "s04_append_changed", "s06_open_alert_once",
    "v07_duplicate_ids", "b02_last_backup", "b07_backup_verdict", "b08_last_of_each_kind", "b12_backup_matrix",
    "k02_blocked_waiters", "k02_lock_edges", "k05_blocker_list", "a01_classify_lines", "a04_notify_on_change", "i08_log_since",
]

SKEWED = {
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id) FROM '{}'",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM '{}'",
    "lineitem": "SELECT * REPLACE (CASE WHEN l_orderkey % 3 = 0 THEN 0 ELSE l_suppkey END AS l_suppkey) FROM '{}'",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    import duckdb

    folder = tmp_path_factory.mktemp("skewed")
    for t in check.TABLES:
        source = f"{FOLDER}/{t}.parquet"
        if t in SKEWED:
            duckdb.execute(f"COPY ({SKEWED[t].format(source)}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        else:
            os.symlink(source, folder / f"{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_skewed_keys(spark, skewed, name):
    names, rows = check.spark_rows(QUERIES[name](spark, skewed))
    assert (names, rows) == check.oracle(check.connect(skewed), SQLS[name])


class Shuffled(Tables):
    def __getattr__(self, name):
        return super().__getattr__(name).repartition(5, F.rand(11))


@pytest.mark.parametrize("name", NAMES)
def test_input_order_does_not_matter(spark, name):
    names, rows = check.spark_rows(QUERIES[name].build(Shuffled(spark, FOLDER)))
    assert (names, rows) == check.oracle(check.connect(FOLDER), SQLS[name])
