import os

import pytest
from pyspark.sql import functions as F

from fleetlens.sinks import tables
from fleetlens.sources import readers as rd


def frame(spark, rows):
    return spark.createDataFrame(rows, "day string, id int, a string, b string")


def test_upsert_keeps_unlisted_columns(spark, rows_of):
    target = frame(spark, [("d1", 1, "old", "keep"), ("d1", 2, "old", "keep")])
    source = frame(spark, [("d1", 2, None, "new"), ("d1", 3, "in", "new")])
    assert rows_of(tables.upsert(target, source, ["day", "id"], ["a"])) == {
        ("d1", 1, "old", "keep"), ("d1", 2, None, "keep"), ("d1", 3, "in", "new"),
    }


def test_upsert_table_touches_only_its_partitions(spark, tmp_path, rows_of):
    path = str(tmp_path / "t")
    rows = frame(spark, [("d1", 1, "x", "x"), ("d2", 1, "x", "x")])
    rows.write.partitionBy("day").option("path", path).saveAsTable("loads")
    before = {d: sorted(os.listdir(f"{path}/day={d}")) for d in ("d1", "d2")}
    source = frame(spark, [("d2", 1, "y", "y"), ("d2", 2, "z", "z")])
    for _ in range(2):  # a replay changes nothing
        tables.upsert_table(spark, "loads", source, ["day", "id"], ["a"], "day")
    # What readers of the old table may still be reading is left alone.
    assert {d: sorted(os.listdir(f"{path}/day={d}")) for d in ("d1", "d2")} == before
    got = spark.table("loads").select("day", "id", "a", "b")
    assert rows_of(got) == {("d1", 1, "x", "x"), ("d2", 1, "y", "x"), ("d2", 2, "z", "z")}
    spark.sql("DROP TABLE loads")


@pytest.mark.parametrize("fails", ["before the switch", "within the switch"])
def test_a_failed_upsert_can_be_run_again(spark, tmp_path, rows_of, monkeypatch, fails):
    rows = [(f"d{i}", 1, "x", "x") for i in range(3)]
    frame(spark, rows).write.partitionBy("day").option("path", str(tmp_path / "t")).saveAsTable("fragile")
    source = frame(spark, [(f"d{i}", 1, "y", "y") for i in range(1, 4)])
    switch = tables.switch_partitions

    def broken(session, table, column, folder, values):
        if fails == "within the switch":
            switch(session, table, column, folder, sorted(values)[:1])
        raise RuntimeError("lost")

    monkeypatch.setattr(tables, "switch_partitions", broken)
    with pytest.raises(RuntimeError, match="lost"):
        tables.upsert_table(spark, "fragile", source, ["day", "id"], ["a"], "day")
    if fails == "before the switch":
        assert rows_of(spark.table("fragile").select("day", "id", "a", "b")) == set(rows)
    monkeypatch.setattr(tables, "switch_partitions", switch)
    tables.upsert_table(spark, "fragile", source, ["day", "id"], ["a"], "day")
    got = rows_of(spark.table("fragile").select("day", "id", "a", "b"))
    assert got == {("d0", 1, "x", "x"), ("d1", 1, "y", "x"), ("d2", 1, "y", "x"), ("d3", 1, "y", "y")}
    spark.sql("DROP TABLE fragile")


def test_partition_column_must_be_a_key(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.upsert_table(spark, "any", frame(spark, []), ["id"], ["a"], "day")


def test_drop_old_partitions(spark, tmp_path):
    df = frame(spark, [("2024-01-01", 1, "x", "x"), ("2024-03-01", 2, "x", "x")])
    df.write.partitionBy("day").format("parquet").option("path", str(tmp_path / "h")).saveAsTable("old_history")
    assert tables.drop_old_partitions(spark, "old_history", "day", "2024-03-10", 42) == ["2024-01-01"]
    assert [r.id for r in spark.table("old_history").collect()] == [2]
    spark.sql("DROP TABLE old_history")


def test_append_changed_is_null_safe(spark, rows_of):
    cols = "k string, v string, ts int"
    target = spark.createDataFrame([("a", "1", 1), ("a", None, 2), ("b", "1", 1)], cols)
    source = spark.createDataFrame([("a", None), ("b", "2"), ("c", None)], "k string, v string")
    assert rows_of(tables.append_changed(target, source, "k", ["v"], "ts")) == {("b", "2"), ("c", None)}


def test_open_alert_once(spark):
    alerts = spark.createDataFrame([("a",)], "k string")
    new = spark.createDataFrame([("a", 1), ("b", 2), ("b", 1)], "k string, at int")
    assert [tuple(r) for r in tables.open_alert_once(alerts, new, "k", ["at"]).collect()] == [("b", 1)]


def test_purge_and_route(spark):
    df = spark.createDataFrame([("2024-01-28", 1), ("2024-01-30", 2), ("2023-12-01", 3)], "d string, id int").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    assert {r.id for r in tables.purge(df, "ts", "2024-01-30", 42).collect()} == {1, 2}
    assert {r.id for r in tables.purge(df, "ts", "2024-01-30", 42, only=F.col("id") > 5).collect()} == {1, 2, 3}
    month, main = tables.route_by_weekday(df, "ts", ["Sun"])
    assert month.count() == 3 and [r.id for r in main.collect()] == [1]


# --- readers ---------------------------------------------------------------------


def write(path, text):
    with open(path, "w", newline="") as f:
        f.write(text)
    return str(path)


def test_delimited_short_and_bad_rows(spark, tmp_path):
    text = "DATABASE, SERVER, TIME, METRIC, VALUE\n-----, -----, -----, -----, -----\nDB1, s, 05-01-24 10:11:12, m, 1.5\nDB2, s, 05-01-24 10:11:12\nDB3, s, nonsense, m, 2\nDB4, s, 05-01-24 10:11:12, m, x\n"
    got = rd.read_delimited(spark, write(tmp_path / "m.dbf", text), rd.METRIC_LOAD).collect()
    assert [(r.database_name, r.value) for r in got] == [("DB1", 1.5), ("DB2", None)]
    assert got[0].space_time.isoformat() == "2024-01-05T10:11:12"


def test_filesystem_load_weekday_prefix(spark, tmp_path):
    line = 's1, /dev/a, 100, 50, 50, 50, /data "x", Fri, Fri-05-Jan-2024-10:11:12\n'
    r = rd.read_delimited(spark, write(tmp_path / "f.dbf", line), rd.FILESYSTEM_LOAD).first()
    assert (r.pctused, r.mountpoint, r.space_time.isoformat()) == (50, '/data "x"', "2024-01-05T10:11:12")


def test_df_listing_wrapped_record(spark, tmp_path):
    text = "Filesystem 1K-blocks Used Available Use% Mounted on\n/dev/sda1   100  40 60  40% /\n/dev/mapper/very-long\n             200 100 100  50% /data\n"
    write(tmp_path / "host1.df", text)
    got = rd.read_df_listings(spark, str(tmp_path)).collect()
    assert {(r.filesystem, r.sizek, r.pctused, r.mountpoint) for r in got} == {("/dev/sda1", 100, 40, "/"), ("/dev/mapper/very-long", 200, 50, "/data")}


def test_connection_file(spark, tmp_path):
    text = "# comment = no\nDB1.WORLD =\n  (DESCRIPTION = (ADDRESS = (HOST = srv1.example.com)(PORT = 1)))\nDB2 = (ADDRESS=(HOST=srv2))\n"
    path = write(tmp_path / "names.ora", text)
    lines = spark.read.text(path)
    assert {r.alias for r in rd.connection_aliases(lines).collect()} == {"DB1.WORLD", "DB2"}
    assert {r.host for r in rd.connection_hosts(lines).collect()} == {"SRV1.EXAMPLE.COM", "SRV2"}
    whole = spark.read.text(path, wholetext=True)
    assert {(r.alias, r.host) for r in rd.alias_hosts(whole).collect()} == {("DB1.WORLD", "srv1"), ("DB2", "srv2")}


def test_quoted_csv(spark, tmp_path):
    path = write(tmp_path / "v.csv", '"vm1","cl,1",\r\n"vm2","cl2"\r\n')
    got = rd.read_quoted_csv(spark, path, ["vm", "cluster"]).collect()
    assert [(r.vm, r.cluster) for r in got] == [("vm1", "cl,1"), ("vm2", "cl2")]


def test_log_order_survives_splits(spark, tmp_path):
    days = ["Mon Jan 01", "Tue Jan 02", "Wed Jan 03"]
    lines = [f"{d} 10:00:00 line {i}" for d in days for i in range(400)]
    path = write(tmp_path / "alert.log", "\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = rd.read_log(spark, path)
        assert log.rdd.getNumPartitions() > 3
        since = rd.log_since(log, "Tue Jan 02")
        assert [r.line for r in since.orderBy("position").collect()] == lines[400:]
        assert {r.line for r in rd.log_last(log, 7).collect()} == set(lines[-7:])
        assert rd.log_since(log, "Sun Jan 07").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_history_is_pruned_and_feeds_the_bands(spark, tmp_path, rows_of):
    from fleetlens.functions.semantics import earliest
    from fleetlens.operators import capacity as cap

    path, keys, now = str(tmp_path / "h"), ["server", "mount"], "2024-03-20 15:30:00"
    df = spark.range(400).select(
        F.concat(F.lit("s"), F.col("id") % 3).alias("server"),
        F.lit("/").alias("mount"),
        (F.lit("2024-03-20 12:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("id") * 5).cast("int"))).alias("ts"),
        (F.col("id") % 90).cast("double").alias("pct"),
    )
    tables.write_history(df, path, "ts", keys)
    recent = tables.read_history(spark, path, "ts", earliest(cap.capacity_bands(now)))
    plan = recent._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(history_day" in plan
    assert rows_of(cap.band_compare(recent, keys, "ts", "pct", now)) == rows_of(cap.band_compare(df, keys, "ts", "pct", now))


def test_lines_that_are_no_rows(spark, tmp_path, rows_of):
    fields = [rd.Field("name"), rd.Field("n", "int"), rd.Field("at", fmt="dd-MM-yy HH:mm:ss")]
    lines = ["NAME, N, AT", "----, -, --", "a, 1, 02-01-24 10:00:00", "b, x, 02-01-24 10:00:00", "c, 2, noon", "", "d", "e, , ", "f, 3, 02-01-24 10:00:00, more"]
    (tmp_path / "load").mkdir()
    (tmp_path / "load" / "one.dbf").write_text("\n".join(lines) + "\n")
    (tmp_path / "load" / "two.dbf").write_text("g, 9999999999, \n")
    rows, rejects = rd.read_delimited_and_rejects(spark, str(tmp_path / "load"), fields)
    assert [r.name for r in rows.orderBy("name").collect()] == ["a", "d", "e", "f"]
    assert rows_of(rows) == rows_of(rd.read_delimited(spark, str(tmp_path / "load"), fields))
    got = {(r.file.rsplit("/", 1)[1], r.line, r.reason) for r in rejects.collect()}
    assert got == {
        ("one.dbf", "NAME, N, AT", "n: 'N' is no int"), ("one.dbf", "----, -, --", "n: '-' is no int"),
        ("one.dbf", "b, x, 02-01-24 10:00:00", "n: 'x' is no int"), ("one.dbf", "c, 2, noon", "at: 'noon' is no dd-MM-yy HH:mm:ss"),
        ("one.dbf", "", "empty line"), ("two.dbf", "g, 9999999999, ", "n: '9999999999' is no int"),
    }
    assert rows.count() + rejects.count() == len(lines) + 1


def test_clustered_history_grows(spark, tmp_path):
    rows = spark.range(40).selectExpr("id % 4 AS k", "timestamp_seconds(id) AS ts", "id AS v")
    for _ in range(2):
        tables.write_clustered(rows, "grown_history", "k", "ts", 4, str(tmp_path / "h"))
    table = spark.table("grown_history")
    assert table.count() == 80 and len(table.inputFiles()) <= 8
    spark.sql("DROP TABLE grown_history")
