"""Plan shape: scans, joins and group limits."""

import pytest

from fleetlens.plans.registry import load_all

FOLDER = "/root/testdata/sf0.001"
QUERIES = load_all()
BATCH = [n for n in QUERIES if n[0] not in "ti" and not n.startswith(("s03", "v20_gated"))]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_pair_joins_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "MapInPandas", "FlatMapGroups"):
        assert bad not in plan, (name, bad)


@pytest.mark.parametrize("name", ["c02_band_compare", "c08_growth_report", "m03_lag_panel", "m04_window_averages"])
def test_history_is_scanned_once(spark, name):
    assert plan_of(QUERIES[name](spark, FOLDER)).count("FileScan") == 1


@pytest.mark.parametrize(
    "name", ["c01_latest_in_band", "c14_latest_per_key", "m03_lag_panel", "i08_log_last", "b11_latest_job_card"]
)
def test_groups_are_limited_before_the_shuffle(spark, name):
    plan = plan_of(QUERIES[name](spark, FOLDER))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_filter_and_columns_reach_the_scan(spark):
    plan = QUERIES["c01_latest_in_band"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_growth_reads_no_further_than_its_longest_horizon(spark):
    plan = QUERIES["c08_growth_report"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "GreaterThan(o_orderdate" in plan


def initial_plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_clustered_history_needs_no_shuffle(spark):
    from fleetlens.operators import capacity, latest, series
    from fleetlens.plans import tables
    from fleetlens.plans.registry import Tables

    history = tables.clustered_events(Tables(spark, FOLDER))
    keys = ["user_id", "event_type"]
    before = spark.conf.get("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    for df in (
        latest.latest_per_key(history, keys, "ts", ["event_id"]),
        capacity.band_compare(history, keys, "ts", "value", as_of="2024-01-30 23:59:59"),
        series.window_averages(history, keys, "ts", "value", series.metric_bands("2024-01-30 12:00:00")),
    ):
        assert "Exchange" not in plan_of(df), plan_of(df)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", before)


def test_rules_and_versions_meet_rows_by_equality(spark):
    plan = plan_of(QUERIES["v02_rows_in_blackout"](spark, FOLDER))
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and not any("sidskip" in line or "hour_from" in line for line in joins)
    assert "collect_set" not in plan_of(QUERIES["v04_checks_to_run"](spark, FOLDER))


def test_what_lies_before_is_found_without_a_hot_task(spark):
    """Predecessors across ranges come from one row per range, and nothing is collected while planning."""
    from fleetlens.operators import series_order

    assert not hasattr(series_order, "ROWS_PER_SLICE")
    plan = plan_of(QUERIES["m09_gap_check"](spark, FOLDER))
    assert "_part" in plan and "Window" in plan
