from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import Band
from fleetlens.operators import series
from fleetlens.operators.series_order import in_ranges, with_previous

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def skewed(spark):
    """6,000 rows: one series holds a third of them, and half of those fall in one second."""
    rows = spark.range(6000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("key"),
        F.when(F.col("id") % 6 == 0, F.lit(1000)).otherwise(F.col("id") * 7 % 5000).alias("second"),
        (F.hash("id") % 100).alias("value"),
    )
    return rows.withColumn(
        "ts", F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("second").cast("decimal(18,6)"))
    )


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_with_previous_equals_plain_lag(skewed, ranges, rows_of):
    window = Window.partitionBy("key").orderBy("ts", "id")
    plain = skewed.select("id", "key", F.lag("value").over(window), F.lag("ts").over(window))
    ours = with_previous(skewed, "key", ["ts", "id"], ["value", "ts"], ranges=ranges)
    assert rows_of(ours.select("id", "key", "prev_value", "prev_ts")) == rows_of(plain)


def test_with_previous_ignores_input_order(skewed, rows_of):
    ours = with_previous(skewed, "key", ["id"], ["value"], ranges=9).select("id", "prev_value")
    shuffled = with_previous(skewed.repartition(7, "value"), "key", ["id"], ["value"], ranges=5)
    assert rows_of(ours) == rows_of(shuffled.select("id", "prev_value"))


def test_hot_series_and_instant_are_spread_over_ranges(skewed):
    rows = in_ranges(skewed, ["key", "ts", "id"], "part", 60)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 250 and sum(sizes) == 6000
    hot = rows.filter("key = 'hot' AND second = 1000").select("part").distinct().count()
    assert hot >= 6


def test_one_series_and_one_instant_hold_everything(spark, rows_of):
    """No key, and no moment, to cut by: the sequence numbers alone tell rows apart."""
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = spark.range(1_000_000).select(F.lit("k").alias("key"), at.alias("ts"), F.col("id"), (F.col("id") * 3).alias("value"))
    out = with_previous(rows.repartition(11), "key", ["ts", "id"], ["value"], ranges=16)
    wrong = out.filter(~F.col("prev_value").eqNullSafe(F.when(F.col("id") > 0, F.col("id") * 3 - 3)))
    assert out.count() == 1_000_000 and wrong.isEmpty()


def test_with_previous_keeps_columns_with_its_own_names(spark):
    df = spark.createDataFrame([("a", 1, 5, "x", "y"), ("a", 2, 6, "u", "v")], "key string, id int, value int, _part string, _rn string")
    out = with_previous(df, "key", ["id"], ["value"], ranges=2)
    assert sorted(map(tuple, out.collect())) == [("a", 1, 5, "x", "y", None), ("a", 2, 6, "u", "v", 5)]
    assert with_previous(df.limit(0), "key", ["id"], ["value"]).count() == 0


def test_gap_reads_what_lies_around_the_late_events(spark):
    """Sequence numbers and times disagree, and the last event before ``since`` is far back."""
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [(1, 1, at(0)), (1, 2, at(5)), (1, 3, at(100)), (1, 4, at(50)), (1, 5, at(130)), (2, 1, at(10)), (2, 2, at(20)), (3, 9, at(120)), (None, 1, at(1)), (None, 2, at(200))]
    df = spark.createDataFrame(rows, "thread int, seq int, ts timestamp_ntz")
    got = {r.thread: r.gap_seconds for r in series.gap_check(df, "thread", ["seq"], "ts", since=at(60)).collect()}
    assert got == {1: 95 * 60, None: 199 * 60}


def test_null_keys_are_a_series_of_their_own(spark):
    df = spark.createDataFrame([(None, i, i * 10) for i in range(50)], "key string, id long, value long")
    out = with_previous(df, "key", ["id"], ["value"], ranges=10)
    assert {r.id: r.prev_value for r in out.collect()} == {i: (i - 1) * 10 if i else None for i in range(50)}


def test_counter_reset_is_skipped(spark):
    df = spark.createDataFrame(
        [("a", 1, 10, 100), ("a", 2, 15, 150), ("a", 3, 2, 20), ("a", 4, 2, 20), ("b", 1, 7, 7)],
        "k string, snap int, waits long, waited long",
    )
    got = {r.snap: (r.snap_waits, r.snap_waited, r.wait_average) for r in series.counter_deltas(df, "k", ["snap"], "waits", "waited").collect()}
    assert got == {2: (5, 50, 10.0), 4: (0, 0, None)}


def test_gap_and_burst(spark):
    at = [T0 + timedelta(minutes=m) for m in (0, 1, 2, 200)]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(at)], "thread int, seq int, ts timestamp_ntz")
    gap = series.gap_check(df, "thread", ["seq"], "ts", since=T0, target_s=3600).first()
    assert (gap.gap_seconds, gap.status) == (198 * 60, "ERROR")
    assert series.burst_check(df, "thread", "ts", limit=2).first().events == 3
    verdict = series.log_switch_verdict(df, "thread", ["seq"], "ts", since=T0, limit=2)
    assert verdict.first().verdict == "WARNING"


def test_averages_anchor_and_band_edges(spark):
    now = T0 + timedelta(hours=12)
    rows = [("a", now, 4.0), ("a", now - timedelta(hours=1), 2.0), ("a", T0, 100.0), ("b", T0 - timedelta(hours=3), 1.0)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v double")
    got = series.window_averages(df, "k", "ts", "v", series.metric_bands(now)).collect()
    assert [r.k for r in got] == ["a"]
    assert (got[0].now_avg, got[0].one_avg, got[0].today_avg, got[0].yesterday_avg) == (4.0, 3.0, 3.0, None)


def test_averages_equal_naive_joins(skewed, rows_of):
    bands = [Band("today", T0 + timedelta(seconds=900)), Band("early", T0, T0 + timedelta(seconds=1000), hi_closed=True)]
    ours = series.window_averages(skewed, "key", "ts", "value", bands)
    naive = None
    for b in bands:
        part = skewed.filter(b.contains("ts")).groupBy("key").agg((F.sum("value") / F.count("value")).alias(b.name))
        naive = part if naive is None else naive.join(part, "key", "left")
    assert rows_of(ours.select("key", "today_avg", "early_avg")) == rows_of(naive.select("key", "today", "early"))


def test_lag_panel_short_series(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(minutes=i), float(i)) for i in range(4)], "k string, ts timestamp_ntz, v double")
    r = series.lag_panel(df, "k", "ts", "v").first()
    assert (r.now_value, r.back_1, r.back_3, r.back_6) == (3.0, 2.0, 0.0, None)


def test_metrics_exclude_and_other(spark):
    events = spark.createDataFrame([("read", 5), ("read", 6), ("idle", 9), ("odd", 2)], "event string, total_waits long")
    mapping = spark.createDataFrame([("read", "WAIT: READ")], "event string, metric string")
    got = series.collect_metrics(events, mapping, exclude=["idle"], other="WAIT: OTHER")
    assert {(r.metric, r.value) for r in got.collect()} == {("WAIT: READ", 11), ("WAIT: OTHER", 2)}


def test_panel_text(spark):
    df = spark.createDataFrame([("a", 12345.0, None)], "k string, now_value double, back_1 double")
    assert tuple(series.panel_text(df, ["now_value", "back_1"]).first()) == ("a", "1.23E+04", "N/A")
