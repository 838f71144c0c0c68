from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.sinks import tables
from fleetlens.streaming import operators as st
from fleetlens.streaming import stateful as sf

T0 = datetime(2024, 1, 1)
COLS = "key string, seq long, ts timestamp, value double"


def feed(spark, path, rows, cols=COLS):
    spark.createDataFrame(rows, cols).coalesce(1).write.mode("append").parquet(str(path))


def source(spark, path, cols=COLS):
    return spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(path))


def windows_of(spark, tmp_path, windows, stream):
    st.drain(stream, st.stored_by_batch(str(tmp_path / "out"), windows.partial), str(tmp_path / "ckpt"))
    return windows.merged(spark.read.parquet(str(tmp_path / "out")))


def recomputed(spark, tmp_path, compute, stream):
    apply = st.recomputed(str(tmp_path / "history"), str(tmp_path / "out"), "key", compute)
    st.drain(stream, apply, str(tmp_path / "ckpt"))
    return spark.read.parquet(str(tmp_path / "out"))


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_late_row_and_open_window_count(spark, tmp_path):
    src = tmp_path / "in"
    windows = st.sliding_averages("key", "ts", "value", "10 minutes", None)
    feed(spark, src, [("a", 1, at(1), 1.0), ("a", 2, at(40), 9.0)])
    windows_of(spark, tmp_path, windows, source(spark, src))
    feed(spark, src, [("a", 3, at(2), 100.0), ("a", 4, at(90), 9.0)])
    got = {r.window_start: (r.samples, r.mean_value) for r in windows_of(spark, tmp_path, windows, source(spark, src)).collect()}
    assert got == {T0: (2, 50.5), at(40): (1, 9.0), at(90): (1, 9.0)}


def test_replayed_batch_counts_once(spark, tmp_path):
    windows = st.windowed_rollup("key", "ts", "value")
    rows = spark.createDataFrame([("a", 1, at(1), 1.0), ("a", 2, at(2), 3.0)], COLS)
    store = st.stored_by_batch(str(tmp_path / "w"), windows.partial)
    once = st.ingest_once(str(tmp_path / "t"), "key", "ts")
    for _ in range(2):
        store(rows, 0)
        once(rows, 0)
    assert [r.samples for r in windows.merged(spark.read.parquet(str(tmp_path / "w"))).collect()] == [2]
    assert spark.read.parquet(str(tmp_path / "t")).count() == 2


def test_windows_close_and_late_rows_are_shown_and_merged(spark, tmp_path, rows_of):
    """Files in an order that disagrees with time: windows close on the way, and later files bring rows for them."""
    rows = [(k, i, at(7 * i), float(i % 13)) for k in "ab" for i in range(400)]
    files = [rows[i::5] for i in range(3)] + [[r for r in rows[i::5] if r[1] >= 200] for i in (3, 4)] + [[r for r in rows[i::5] if r[1] < 200] for i in (3, 4)]
    windows = st.sliding_averages("key", "ts", "value", "2 hours", "1 hour")
    kept = st.WindowTables(windows, str(tmp_path / "w"), "90 MINUTES")
    for part in files:
        feed(spark, tmp_path / "in", part)
        st.drain(source(spark, tmp_path / "in"), kept.store, str(tmp_path / "ckpt"))
    want = windows.merged(windows.partial(spark.createDataFrame(rows, COLS)))
    assert rows_of(kept.current(spark)) == rows_of(want)
    late = kept.part(spark, "late")
    assert {r.batch for r in late.select("batch").distinct().collect()} <= set(range(1, len(files)))
    assert late.filter(F.col("window_end") < F.lit(at(60 * 20))).count() > 0
    closed = kept.part(spark, "closed")
    assert closed.count() == closed.select("key", "window_start").distinct().count() > 0
    assert rows_of(kept.closed(spark)) != rows_of(want)


def test_replayed_windows_and_old_days(spark, tmp_path, rows_of):
    """Each batch is applied twice; days that the watermark has passed are no longer kept as open."""
    windows = st.windowed_high_water(["key"], "ts", "value", tie_break=["seq"])
    kept = st.WindowTables(windows, str(tmp_path / "w"), "1 DAY")
    rows = [("a", i, at(60 * 11 * i), float(i % 7)) for i in range(60)]
    for number, part in enumerate((rows[:20], rows[20:40], rows[5:6], rows[40:])):
        batch = spark.createDataFrame(part, COLS)
        for _ in range(2):
            kept.store(batch, number)
    twice = spark.createDataFrame([*rows, rows[5]], COLS)
    assert rows_of(kept.current(spark)) == rows_of(windows.merged(windows.partial(twice)))
    days = sorted(p.name for p in (tmp_path / "w" / "open").iterdir() if p.name.startswith("end_day"))
    assert days[0] >= "end_day=2024-01-17"
    assert [r.batch for r in kept.part(spark, "late").collect()] == [2]


def test_a_replayed_panel_replaces_itself(spark, tmp_path):
    store = st.stored_by_batch(str(tmp_path / "p"), lambda batch: batch)
    old, new = ((("a", at(i), float(i)),) for i in (1, 2))
    cols = "key string, ts timestamp, now_value double"
    for number, rows in ((0, old), (1, new), (1, new)):
        store(spark.createDataFrame(list(rows), cols), number)
    assert [r.now_value for r in sf.newest_panels(spark.read.parquet(str(tmp_path / "p"))).collect()] == [2.0]


def in_order(spark, tmp_path, build, cols, files):
    sf.use_rocksdb(spark)
    counts = []
    for part in files:
        feed(spark, tmp_path / "in", part, cols)
        st.write_available(build(source(spark, tmp_path / "in", cols)), str(tmp_path / "out"), str(tmp_path / "ckpt"))
        counts.append(spark.read.parquet(str(tmp_path / "out")).count())
    return spark.read.parquet(str(tmp_path / "out")), counts


def test_a_reminder_needs_no_new_row(spark, tmp_path):
    """Key a fails and falls silent; another key moves the time on."""
    cols = "key string, seq long, ts timestamp, value string"
    files = [[("a", 1, at(0), "ok"), ("a", 2, at(10), "error")], [("b", 1, at(300), "ok")], [("b", 2, at(330), "ok"), ("a", 3, at(320), "ok")], [("b", 3, at(600), "ok")]]
    got, counts = in_order(spark, tmp_path, lambda s: sf.notices_in_order(s, "5 minutes", "error", 3600), cols, files)
    a = sorted((r.ts, r.state, r.decision) for r in got.collect() if r.key == "a")
    reminders = [(at(10 + 60 * k), "error", "REMINDER") for k in range(1, 6)]
    assert a == [(at(0), "ok", "CHANGED"), (at(10), "error", "CHANGED"), *reminders, (at(320), "ok", "CHANGED")]
    # The second file brings a row of b only: a's change and its reminders up to then come out with it.
    assert counts[0] == 1 and counts[1] - counts[0] == 5 and counts[2] - counts[1] == 3


def test_in_order_equals_batch_on_shuffled_files(spark, tmp_path, rows_of):
    """Rows up to a day late, dealt to files against their order; a last file moves the time past all."""
    cols = "key string, seq long, ts timestamp, value long"
    rows = [(k, i, at(i), (i * 37) % 50) for k in "ab" for i in range(90)]
    files = [rows[2::3], rows[::3], rows[1::3], [("clock", 0, at(60 * 48), 0), ("clock", 1, at(60 * 24 * 9), 0)]]
    got, _ = in_order(spark, tmp_path, lambda s: sf.deltas_in_order(s, "1 day"), cols, files)
    want = sf.deltas(spark.createDataFrame(rows, cols))
    assert rows_of(got.filter("key <> 'clock'").select("key", "seq", "ts", "delta")) == rows_of(want)


def test_a_blackout_entered_later_counts_from_the_next_batch(spark, tmp_path, monkeypatch):
    rules = []
    monkeypatch.setattr(st, "rows_in_blackout", lambda df, known, ts, inside: df.filter(~F.col("key").isin(*known)))
    store = st.suppress_blackouts(str(tmp_path / "q"), lambda: list(rules), "ts")
    for number in range(2):
        store(spark.createDataFrame([("a", number, at(number), 0.0), ("b", number, at(number), 0.0)], COLS), number)
        rules.append("a")
    assert sorted((r.key, r.seq) for r in spark.read.parquet(str(tmp_path / "q")).collect()) == [("a", 0), ("b", 0), ("b", 1)]


def test_notices_after_late_rows(spark, tmp_path):
    cols = "key string, seq long, ts timestamp, state string"
    src = tmp_path / "in"
    notices = lambda rows: sf.notices(rows, "error", 3600)
    feed(spark, src, [("a", 2, at(1), "error"), ("a", 5, at(63), "ok"), ("b", 1, at(0), "ok")], cols)
    recomputed(spark, tmp_path, notices, source(spark, src, cols))
    feed(spark, src, [("a", 1, at(0), "ok"), ("a", 3, at(30), "error"), ("a", 4, at(62), "error"), ("b", 2, at(500), "ok")], cols)
    got = {(r.key, r.seq, r.decision) for r in recomputed(spark, tmp_path, notices, source(spark, src, cols)).collect()}
    assert got == {("a", 1, "CHANGED"), ("a", 2, "CHANGED"), ("b", 1, "CHANGED"), ("a", 4, "REMINDER"), ("a", 5, "CHANGED")}


def test_reminders_of_many_runs_pass_in_batches(spark):
    """Runs that batches of two rows cut, against a walk; no Python call for each run."""
    rows = [(k, i, at(i * 7 + k), "error" if (i * (k + 3)) % 11 < 8 else "ok") for k in range(5) for i in range(60)]
    want = set()
    for k in range(5):
        state = told = None
        for _, seq, ts, new in [r for r in rows if r[0] == k]:
            decision = "CHANGED" if new != state else "REMINDER" if new == "error" and ts - told > timedelta(minutes=15) else None
            state = new
            if decision:
                told = ts
                want.add((k, seq, decision))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = sf.notices(spark.createDataFrame(rows, "key long, seq long, ts timestamp, state string"), "error", 900)
        assert {(r.key, r.seq, r.decision) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert any(d == "REMINDER" for _, _, d in want)
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().sparkPlan().toString()


def test_counter_deltas_equal_batch(spark, tmp_path, rows_of):
    cols = "key string, seq long, ts timestamp, value long"
    rows = [(k, i, at(i), (i * 37) % 50) for k in "ab" for i in range(40)]
    src = tmp_path / "in"
    for part in (rows[1::2], rows[::2]):
        feed(spark, src, part, cols)
        got = recomputed(spark, tmp_path, sf.deltas, source(spark, src, cols))
    batch = spark.createDataFrame(rows, cols).withColumn("time", F.col("value"))
    want = series.counter_deltas(batch, "key", ["seq"], "value", "time").select("key", "seq", "snap_waits")
    assert rows_of(got.select("key", "seq", "delta")) == rows_of(want)


def test_two_versions_of_a_key_in_one_batch(spark, tmp_path):
    cols = "id long, day string, value double"
    rows = spark.createDataFrame([(1, "d", 0.0), (2, "d", 0.0)], cols)
    rows.write.partitionBy("day").option("path", str(tmp_path / "t")).saveAsTable("versions")
    batch = spark.createDataFrame([(1, "d", 5.0), (1, "d", 7.0), (3, "e", 1.0)], cols)
    apply = st.upsert_batches("versions", ["id", "day"], ["value"], "day", ["value"])
    for _ in range(2):
        apply(batch, 0)
        got = sorted((r.id, r.value) for r in spark.table("versions").collect())
        assert got == [(1, 7.0), (2, 0.0), (3, 1.0)]
    spark.sql("DROP TABLE versions")


def test_upsert_refuses_a_repeated_key(spark):
    target = spark.createDataFrame([(1, 0.0)], "id long, value double")
    source_ = spark.createDataFrame([(1, 5.0), (1, 7.0)], "id long, value double")
    with pytest.raises(Exception, match="repeats a key"):
        tables.upsert(target, source_, "id", ["value"]).collect()


@pytest.fixture(scope="module")
def layouts(spark, tmp_path_factory):
    """The tables once as they are, once with events dealt by hash to four files, read one file at a time."""
    from fleetlens.plans import streams

    root = tmp_path_factory.mktemp("layouts")
    for name in ("events", "customer"):
        table = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        (table.repartition(4, F.xxhash64("event_id")) if name == "events" else table).write.parquet(str(root / f"{name}.parquet"))
    before, streams.FILES_PER_BATCH = streams.FILES_PER_BATCH, 1
    yield str(root)
    streams.FILES_PER_BATCH = before


@pytest.mark.parametrize("name", ["t01_sliding_averages", "t02_daily_high_water", "t02_hourly_rollup", "t03_notify_changes", "t04_samples_ago", "t05_counter_deltas", "t06_upsert_batches", "t06_ingest_once", "t07_suppress_blackouts"])
def test_file_layout_changes_nothing(spark, layouts, name, rows_of):
    from fleetlens.plans.registry import load_all

    query = load_all()[name]
    assert rows_of(query(spark, layouts)) == rows_of(query(spark, "/root/testdata/sf0.001"))


def test_samples_ago_across_batches(spark, tmp_path):
    sf.use_rocksdb(spark)
    src = tmp_path / "in"
    seen = []
    for part in (range(0, 5), range(5, 20)):
        feed(spark, src, [("a", i, at(i), float(i)) for i in part])
        q = (
            sf.samples_ago(source(spark, src), (1, 6, 12)).writeStream.outputMode("update")
            .foreachBatch(lambda df, _: seen.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
        )
        q.awaitTermination()
    assert [(r.now_value, r.back_1, r.back_6, r.back_12) for r in seen] == [(4.0, 3.0, None, None), (19.0, 18.0, 13.0, 7.0)]


def test_repeated_snapshots_are_kept_once(spark, tmp_path):
    src = tmp_path / "in"
    once = st.ingest_once(str(tmp_path / "out"), "key", "ts")
    for rows in ([("a", 1, at(0), 1.0), ("a", 2, at(0), 1.0)], [("a", 3, at(0), 1.0), ("a", 4, at(5), 1.0), ("a", 5, at(-5000), 1.0)]):
        feed(spark, src, rows)
        st.drain(source(spark, src), once, str(tmp_path / "ckpt"))
    assert sorted(r.ts for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [at(-5000), at(0), at(5)]
