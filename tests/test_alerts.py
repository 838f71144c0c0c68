from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import alerts as al
from fleetlens.operators import health as hl
from fleetlens.operators import locks as lk

NOW = datetime(2024, 1, 2, 12)


@pytest.mark.parametrize(
    "line,level",
    [
        ("+ Space Summary +", "HEADING"),
        ("3 successes and failures", "NEUTRAL"),
        ("** WARNING - ERROR seen **", "WARNING"),
        ("Database in NOARCHIVELOG Mode", "WARNING"),
        ("UNDO (u) [XXXXXXXXXXXXXXXXXX--]", "WARNING"),
        ("TEMP (t) [XXXXXXXXXXXXXXXXXXX-]", "WARNING"),
        ("USERS [XXXXXXXXXXXXXXXXXXXX]", "ERROR"),
        ("USERS [XXXXXXXXXXXXXXXXX---]", "NEUTRAL"),
        ("USERS [XXXXXXXXXXXXXXXXXX--] then more", "NEUTRAL"),
        ("job failed", "ERROR"),
        ("fine", "NEUTRAL"),
    ],
)
def test_line_levels(spark, line, level):
    df = spark.createDataFrame([("DB", line)], "target string, line string")
    assert al.classify_lines(df).first().level == level


def test_backup_failure_is_softened_only_for_quiet_targets(spark):
    rows = [("A", "No RMAN alerts for A today"), ("A", "Last Backup FAILURE"), ("B", "Last Backup FAILURE")]
    df = al.classify_lines(spark.createDataFrame(rows, "target string, line string"))
    got = {(r.target, r.level) for r in df.filter(F.col("line").contains("FAILURE")).collect()}
    assert got == {("A", "WARNING"), ("B", "ERROR")}
    assert {r.target: (r.warning_count, r.error_count) for r in al.severity_counts(df).collect()} == {"A": (1, 0), "B": (0, 1)}


def test_temporary_error_text_is_softened(spark):
    df = spark.createDataFrame([("A", "TEMP (t) ERROR [XXXXXXXXXXXXXXXXXX--]")], "target string, line string")
    assert al.classify_lines(df).first().shown.startswith("TEMP (t) WARNING")


def decisions(spark, current, previous, minutes_ago=120, **kw):
    cols = "target string, line string, is_error boolean"
    last = spark.createDataFrame([("A", NOW - timedelta(minutes=minutes_ago))], "target string, notified_at timestamp_ntz")
    out = al.notify_on_change(spark.createDataFrame(current, cols), spark.createDataFrame(previous, cols), last, NOW, **kw)
    return {r.target: r.decision for r in out.collect()}


def test_notify(spark):
    good, bad = ("A", "fine (3 ms)", False), ("A", "ERROR down", True)
    assert decisions(spark, [bad], [good]) == {"A": "CHANGED"}
    assert decisions(spark, [("A", "fine (9 ms)", False)], [good]) == {"A": "NONE"}
    assert decisions(spark, [good, ("A", "completed at 9", False)], [good]) == {"A": "NONE"}
    assert decisions(spark, [bad], [bad]) == {"A": "REMINDER"}
    assert decisions(spark, [bad], [bad], minutes_ago=30) == {"A": "NONE"}
    assert decisions(spark, [good], [good], remind_only_if_error=False) == {"A": "REMINDER"}
    assert decisions(spark, [bad, bad], [bad]) == {"A": "CHANGED"}
    assert decisions(spark, [], [bad]) == {"A": "CHANGED"}


def test_probe_ladder(spark):
    rows = [("skip", False, 1, False), ("gone", False, 1, True), ("slow", True, 10_001, True), ("shut", True, 5, False), ("ok", True, 10_000, True)]
    results = spark.createDataFrame(rows, "target string, ping_ok boolean, ping_ms int, login_ok boolean")
    skips = spark.createDataFrame([("skip", "planned")], "target string, reason string")
    out = al.probe_status(results, skips)
    assert {r.target: r.status for r in out.collect()} == {"skip": "SKIPPED", "gone": "ERROR", "slow": "WARNING", "shut": "ERROR", "ok": "OK"}
    assert al.report_status(out).first().status == "ERROR"
    assert al.report_status(out.filter("target in ('skip', 'slow')")).first().status == "WARNING"


def test_histogram_skips_warnings(spark):
    lines = spark.createDataFrame([("ORA-1 x",), ("ORA-1 x",), ("ORA-2 (WARN)",), ("ok",)], "line string")
    assert [tuple(r) for r in al.error_histogram(lines).collect()] == [("ORA-1 x", 2)]


def test_lock_edges_reach_every_pair(spark):
    locks = spark.createDataFrame(
        [(1, 7, 0, 1, 0), (2, 7, 0, 1, 0), (3, 7, 0, 0, 6), (4, 7, 0, 0, 6), (5, 8, 0, 1, 0)],
        "sid int, id1 int, id2 int, block int, request int",
    )
    sessions = spark.createDataFrame(
        [(i, i, "u", "o", "h.x", "p.exe", NOW - timedelta(hours=9 - i), i * 3600, "USER") for i in range(1, 6)],
        "sid int, serial int, username string, osuser string, machine string, program string, logon_time timestamp_ntz, last_call_et int, type string",
    )
    edges = lk.lock_edges(locks, sessions)
    holds = edges.filter("edge = 'holds'").withColumnRenamed("sid", "holder")
    waits = edges.filter("edge = 'waits'").withColumnRenamed("sid", "waiter")
    pairs = holds.join(waits, ["id1", "id2"]).select("holder", "waiter")
    assert {tuple(r) for r in pairs.collect()} == {(1, 3), (1, 4), (2, 3), (2, 4)}
    waiters = lk.blocked_waiters(locks, sessions)
    assert {(r.holder_sid, r.holders, r.waiter_sid) for r in waiters.collect()} == {(1, 2, 3), (1, 2, 4)}
    assert lk.wait_tier(waiters).first().tier == 120


def test_every_broken_or_failed_job_is_listed(spark):
    rows = [(i, "u", NOW, "Y" if i % 2 else "N", i % 3, "w") for i in range(12)]
    jobs = spark.createDataFrame(rows, "job int, log_user string, last_date timestamp_ntz, broken string, failures int, what string")
    either = {r[0] for r in rows if r[3] == "Y" or r[4] > 0}
    assert len(either) > 5
    assert {r.job for r in hl.broken_jobs(jobs).collect()} == either


def test_password_messages(spark):
    rows = [("a", "OPEN", NOW + timedelta(days=30), "P"), ("b", "OPEN", NOW + timedelta(days=32), "P"), ("c", "EXPIRED", None, "P"), ("d", "OPEN", None, "P")]
    users = spark.createDataFrame(rows, "username string, account_status string, expiry_date timestamp_ntz, profile string")
    issues = hl.password_expiry(users, NOW)
    assert {r.username for r in issues.collect()} == {"a", "c"}
    assert "2 users" in hl.password_expiry_message(issues).first().message
    assert "No Password" in hl.password_expiry_message(issues.filter("username = 'x'")).first().message


def test_daily_sketches_merge_to_the_whole(spark, rows_of):
    lines = spark.range(6000).selectExpr("id % 5 AS day", "concat('FAILED ', least(id % 97, id % 89)) AS line")
    lines = lines.unionByName(spark.createDataFrame([(1, "FAILED (WARN)"), (2, "fine")], "day long, line string"))
    sketches = al.error_sketches(lines, "day", pattern="FAILED|fine", tracked=1000)
    assert sketches.count() == 5
    whole = al.error_histogram(lines, pattern="FAILED|fine").select("line", "occurrences")
    assert rows_of(al.most_frequent(sketches, 500, tracked=1000)) == rows_of(whole)
    per_day = lines.filter("day = 3").groupBy("line").count()
    assert rows_of(al.most_frequent(sketches.filter("day = 3"), 500, tracked=1000)) == rows_of(per_day)


def test_a_small_sketch_keeps_the_frequent_lines(spark):
    rows = spark.range(30_000).selectExpr("0 AS day", "CASE WHEN id % 3 = 0 THEN 'FAILED often' WHEN id % 5 = 0 THEN 'FAILED too' ELSE concat('FAILED ', id) END AS line")
    top = al.most_frequent(al.error_sketches(rows, "day", pattern="FAILED", tracked=200), 2, tracked=200).collect()
    exact = {"FAILED often": 10_000, "FAILED too": 4_000}
    assert {r.line for r in top} == set(exact) and all(abs(r.occurrences - exact[r.line]) < 1000 for r in top)
