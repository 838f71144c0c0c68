import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import capacity as cap
from fleetlens.operators import latest

NOW = datetime(2024, 3, 20, 15, 30)
DAY0 = datetime(2024, 3, 20)


def history(spark, rows):
    return spark.createDataFrame(rows, "server string, mount string, ts timestamp_ntz, pct double, seq int")


def at(days, hours=0):
    return DAY0 - timedelta(days=days) + timedelta(hours=hours)


def test_band_edges_share_midnights(spark):
    bands = {b.name: b for b in cap.capacity_bands(NOW)}
    times = {"today": at(0), "before today": at(0, -0.001), "7": at(7), "13": at(13), "62": at(62), "63": at(62, -0.001)}
    df = spark.createDataFrame([(k, v) for k, v in times.items()], "k string, ts timestamp_ntz")
    inside = {n: {r.k for r in df.filter(b.contains("ts")).collect()} for n, b in bands.items()}
    assert inside["now"] == {"today"}
    assert inside["yesterday"] == {"before today", "7"}
    assert inside["lastweek"] == {"7", "13"}
    assert inside["lastmonth"] == {"13", "62"}


def compared(spark, now, yesterday=None, week=None, month=None, **kw):
    rows = [("s", "/", at(0, 1), now, 1)]
    for value, days in ((yesterday, 1), (week, 8), (month, 20)):
        if value is not None:
            rows.append(("s", "/", at(days), value, 1))
    return cap.band_compare(history(spark, rows), ["server", "mount"], "ts", "pct", NOW, **kw)


@pytest.mark.parametrize(
    "now,week,expected",
    [
        (99, 98, "Error: Weekly growth"),
        (96, 93, "Error: Weekly growth"),
        (96, 94, "OK"),
        (51, 1, "Error: Weekly growth"),
        (50, 0, "OK"),
    ],
)
def test_ladder_edges(spark, now, week, expected):
    rows = compared(spark, float(now), float(now), float(week), 0.0)
    assert cap.growth_status(rows).first().status == expected


def test_weighting_and_tiers(spark):
    rows = compared(spark, 96.5, 96.0, 96.0, 0.0)
    assert cap.growth_status(rows, tiered=True).first().status == "OK"
    assert cap.growth_status(rows, tiered=True, weighting=8).first().status == "Error: Weekly growth (Brown)"


def test_missing_bands_fall_back_and_do_not_fire(spark):
    r = cap.growth_status(compared(spark, 99.0, how="left")).first()
    assert (r.yesterday_pct, r.lastweek_pct, r.lastmonth_pct, r.month_growth, r.status) == (0, 0, 0, 99, "OK")
    assert r.no_yesterday and r.no_lastweek and r.no_lastmonth
    r = compared(spark, 60.0, 50.0, how="left").first()
    assert (r.lastweek_pct, r.lastmonth_pct) == (50, 50)
    assert compared(spark, 60.0, 50.0).count() == 0


def test_single_pass_equals_four_scans(spark, rows_of):
    rng = random.Random(5)
    rows = [
        (f"s{rng.randrange(4)}", f"/{rng.randrange(3)}", DAY0 - timedelta(hours=rng.randrange(-15, 24 * 65)), float(rng.randrange(100)), i)
        for i in range(3000)
    ]
    df = history(spark, rows)
    keys = ["server", "mount"]
    naive = None
    for b in cap.capacity_bands(NOW):
        part = latest.top_rows(df.filter(b.contains("ts")), keys, latest.newest_first("ts", "seq"))
        part = part.select(*keys, F.col("pct").alias(b.name))
        naive = part if naive is None else naive.join(part, keys)
    ours = cap.band_compare(df, keys, "ts", "pct", NOW, tie_break=["seq"])
    picked = ours.select(*keys, "now_pct", "yesterday_raw", "lastweek_raw", "lastmonth_raw")
    assert rows_of(picked) == rows_of(naive)


def test_ties_are_kept_in_a_band_and_broken_per_key(spark):
    rows = [("s", "/", at(0, 1), 1.0, 1), ("s", "/", at(0, 1), 2.0, 2), ("s", "/", at(0), 3.0, 3)]
    df = history(spark, rows)
    band = cap.capacity_bands(NOW)[0]
    assert {r.seq for r in latest.latest_in_band(df, ["server", "mount"], "ts", band).collect()} == {1, 2}
    assert [r.seq for r in latest.latest_per_key(df, ["server", "mount"], "ts", ["seq"]).collect()] == [2]


def test_empty_history(spark):
    assert cap.band_compare(history(spark, []), ["server", "mount"], "ts", "pct", NOW).count() == 0


def test_override_ladder(spark):
    limits = spark.createDataFrame([("s", 70.0, None, None, None), ("t", None, None, None, 5.0)],
        "server string, error_pct_day double, error_pct_week double, error_pct_month double, error_size_in_k double")
    rows = [("s", "/", at(0, 1), 71.0, 1), ("s", "/", at(1), 70.0, 1), ("t", "/", at(0, 1), 10.0, 9), ("t", "/", at(1), 10.0, 9)]
    df = cap.band_compare(history(spark, rows), ["server", "mount"], "ts", "pct", NOW, how="left", extra=["seq"])
    got = cap.growth_status_overrides(df, limits, "server", used="seq")
    assert {(r.server, r.status) for r in got.collect()} == {("s", "*ERROR (day)*"), ("t", "*ERROR (size)*")}


def test_projected_full(spark):
    none = spark.createDataFrame([], "server string, error_pct_day double, error_pct_week double, error_pct_month double, error_size_in_k double")
    status = lambda df: cap.growth_status_overrides(df.withColumn("usedk", F.lit(1)), none, "server").first().status
    assert status(compared(spark, 40.0, 25.0, how="left")) == "*ERROR (day)*"
    assert status(compared(spark, 40.0, 26.0, how="left")) == " "


def test_thresholds_most_specific_wins(spark):
    params = spark.createDataFrame(
        [("server01", None, None, 70.0), ("OEMDEV", "server01", None, 60.0), ("USERS", "OEMDEV", "server01", 50.0)],
        "param_name string, param_parent string, param_grand_parent string, param_value_num double",
    )
    entities = spark.createDataFrame(
        [("USERS", "OEMDEV", "server01"), ("DATA", "OEMDEV", "server01"), ("DATA", "OTHER", "server01"), ("DATA", "OEMDEV", "server02")],
        "container string, database_name string, server string",
    )
    got = {(r.container, r.database_name, r.server): r.threshold for r in cap.resolve_threshold(entities, params).collect()}
    assert list(map(got.get, [("USERS", "OEMDEV", "server01"), ("DATA", "OEMDEV", "server01"), ("DATA", "OTHER", "server01"), ("DATA", "OEMDEV", "server02")])) == [50, 60, 70, 95]


def test_high_water_keeps_first_sample_of_the_maximum(spark):
    rows = [("s", "/", at(1, 1), 5.0, 1), ("s", "/", at(1, 2), 9.0, 2), ("s", "/", at(1, 3), 9.0, 3), ("s", "/", at(0, 1), 1.0, 4)]
    got = cap.daily_high_water(history(spark, rows), ["server", "mount"], "ts", "pct")
    assert {r.seq for r in got.collect()} == {2, 4}


def test_growth_report_zero_base(spark):
    rows = [("a", at(30), 0.0), ("a", at(0, 1), 5.0), ("b", at(30), 4.0), ("b", at(0, 1), 5.0)]
    df = spark.createDataFrame(rows, "db string, ts timestamp_ntz, gig double")
    got = {r.db: r for r in cap.growth_report(df, "db", "ts", "gig", NOW).collect()}
    assert got["a"].month_growth is None and got["a"].month_growth_pct is None
    assert (got["b"].month_growth, got["b"].year_growth_pct) == (1.0, 25.0)


def test_usage_bar(spark):
    df = spark.createDataFrame([(0.0,), (90.0,), (100.0,), (None,)], "p double").select(cap.usage_bar(F.col("p")).alias("b"))
    assert [r.b for r in df.collect()] == [
        "[--------------------]", "[XXXXXXXXXXXXXXXXXX--]", "[XXXXXXXXXXXXXXXXXXXX]", "[------OFFLINE-------]",
    ]


def test_empty_and_offline_containers_are_listed(spark):
    cols = "database_name string, container string, bytes long, maxbytes long"
    meg = 1048576
    data = spark.createDataFrame([("A", "full", 100 * meg, 100 * meg), ("A", "temp", 5 * meg, None), ("B", "empty", 10 * meg, 20 * meg), ("C", "offline", None, None)], cols)
    free = spark.createDataFrame([("B", "empty", 10 * meg)], "database_name string, container string, bytes long")
    kinds = data.select("database_name", "container", F.when(F.col("container") == "temp", "TEMPORARY").otherwise("PERMANENT").alias("contents"))
    usage = cap.container_usage([data], free, kinds, ["database_name", "container"])
    assert {r.container: r.pct_used for r in usage.collect()} == {"full": 100.0, "temp": 100.0, "empty": 0.0, "offline": None}
    assert cap.container_usage([data], free, kinds, ["database_name", "container"], min_pct=0).count() == 2
    alerts = {(r.database_name, r["item"], r.message) for r in cap.container_alerts(usage, "database_name", "container").collect()}
    assert alerts == {
        ("A", "full(100%)", "** ERROR - tablespace alerts on A: full(100%) **"),
        ("B", None, "** No tablespace alerts for B **"),
        ("C", None, "** No tablespace alerts for C **"),
    }
    assert cap.container_snapshot(usage, "container", datetime(2024, 1, 1)).count() == 4


def test_peers_and_staleness(spark):
    dbs = spark.createDataFrame([("A", "s1", "N", "N"), ("B", "s2", "N", "Y"), ("C", "s3", "N", "Y"), ("D", "s2", "Y", "Y")],
        "database_name string, server string, disabled string, os_checks_ind string")
    servers = spark.createDataFrame([("s1", "h1"), ("s2", "h1"), ("s3", "h2")], "server string, physical_server_abbrev string")
    assert [tuple(r) for r in cap.expand_to_peers(dbs, servers, "A").collect()] == [("h1", "B")]
    df = spark.createDataFrame([("a", NOW - timedelta(days=2))], "k string, ts timestamp_ntz")
    assert cap.staleness(df, "ts", NOW, "k").first().status == "WARNING"
    assert cap.staleness(df.filter("k = 'z'"), "ts", NOW).first().status == "DISABLED"


def test_month_end_keeps_all_rows_of_the_last_day(spark):
    rows = [("a", datetime(2024, 2, 27), 1.0), ("a", datetime(2024, 2, 28, 1), 2.0), ("a", datetime(2024, 2, 28, 9), None), ("b", datetime(2024, 2, 1), 3.0), ("b", datetime(2022, 2, 1), 3.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, gig double")
    got = latest.month_end_series(df, "k", "ts", "gig", NOW).collect()
    assert sorted((r.k, r.month_no, r.gig) for r in got) == [("a", "2402", 0.0), ("a", "2402", 2.0), ("b", "2402", 3.0)]
