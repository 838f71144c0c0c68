from datetime import datetime, timedelta

import pytest

from fleetlens.operators import backups as bk

NOW = datetime(2024, 5, 10, 8)
JOB = "db_key int, session_key int, db_name string, input_type string, status string, start_time timestamp_ntz, end_time timestamp_ntz, input_bytes double"


def job(key, kind, status, hours_ago, length=1, db=1):
    start = NOW - timedelta(hours=hours_ago)
    return (db, key, "DB", kind, status, start, start + timedelta(hours=length), 3600.0 * 1048576)


def verdict(spark, jobs, days=1, mode="ARCHIVELOG"):
    policy = spark.createDataFrame([(1, days, mode)], "db_key int, check_days int, log_mode string")
    return bk.backup_verdict(spark.createDataFrame(jobs, JOB), policy, NOW).first()


def test_verdicts(spark):
    ok = job(1, "DB FULL", "COMPLETED", 20)
    assert verdict(spark, [ok]).verdict == "OK"
    assert verdict(spark, [ok], days=0).verdict == "DISABLED"
    assert verdict(spark, [ok], mode="NOARCHIVELOG").verdict == "NOT APPLICABLE"
    r = verdict(spark, [job(1, "DB FULL", "COMPLETED", 50)])
    assert (r.verdict, r.no_database_backup) == ("ERROR: none recent", False)
    r = verdict(spark, [job(1, "ARCHIVELOG", "COMPLETED", 50)])
    assert (r.verdict, r.no_database_backup) == ("ERROR: none recent", True)
    later = job(2, "ARCHIVELOG", "FAILED", 5)
    assert verdict(spark, [ok, later]).verdict == "ERROR: last failed"
    assert verdict(spark, [ok, job(2, "ARCHIVELOG", "RUNNING", 1)]).verdict == "OK"


def test_start_at_the_limit_does_not_count(spark):
    midnight = datetime(2024, 5, 9)
    exact = (1, 1, "DB", "DB FULL", "COMPLETED", midnight, midnight, 1.0)
    after = (1, 1, "DB", "DB FULL", "COMPLETED", midnight + timedelta(microseconds=1), midnight, 1.0)
    assert verdict(spark, [exact]).verdict == "ERROR: none recent"
    assert verdict(spark, [after]).verdict == "OK"


def test_old_log_backups_do_not_count_as_recent(spark):
    assert verdict(spark, [job(1, "ARCHIVELOG", "COMPLETED", 24 * 90)]).verdict == "ERROR: none recent"


def test_speed(spark):
    r = bk.backup_speed(spark.createDataFrame([(*job(1, "DB FULL", "COMPLETED", 5, 1.5), 2.0)], JOB + ", compression_ratio double"), NOW).first()
    assert (r.hours, r.minutes, r.seconds) == (1, 30, 0)
    assert r.mb_per_sec == pytest.approx(3600 / 5400)


def test_age_policy(spark):
    cols = "database_name string, check_days int, blackout_from timestamp_ntz, blackout_to timestamp_ntz, fuzzy_char_before string, fuzzy_char_after string"
    rules = [
        ("PRD", 5, None, None, "N", "Y"),
        ("TEST", 9, None, None, "Y", "Y"),
        ("_X", 7, None, None, "Y", "N"),
        ("PRDA", 2, None, None, "N", "N"),
        ("PRDB", 4, NOW - timedelta(days=1), NOW + timedelta(days=1), "N", "N"),
        ("PRDC", 4, NOW - timedelta(days=3), NOW - timedelta(days=1), "N", "N"),
    ]
    names = ["PRDA", "PRDB", "PRDC", "MYTESTDB", "A_X", "AX", "OTHER"]
    dbs = spark.createDataFrame([(n,) for n in names], "database_name string")
    got = bk.backup_age_policy(dbs, spark.createDataFrame(rules, cols), NOW)
    assert {r.database_name: r.check_days for r in got.collect()} == {
        "PRDA": 2, "PRDB": 0, "PRDC": 5, "MYTESTDB": 9, "A_X": 7, "AX": 1, "OTHER": 1,
    }


def test_age_policy_broadcasts_rules_not_pieces(spark, tmp_path):
    cols = "database_name string, check_days int, blackout_from timestamp_ntz, blackout_to timestamp_ntz, fuzzy_char_before string, fuzzy_char_after string"
    spark.range(1000).selectExpr("concat('DB', id) AS database_name").write.parquet(str(tmp_path / "dbs"))
    rules = spark.createDataFrame([("B7", 5, None, None, "Y", "Y"), ("DB8", 3, None, None, "N", "N")], cols)
    got = bk.backup_age_policy(spark.read.parquet(str(tmp_path / "dbs")), rules, NOW)
    lines = got._jdf.queryExecution().sparkPlan().toString().splitlines()
    pieces = next(i for i, x in enumerate(lines) if "BroadcastHashJoin [piece" in x)
    assert "BuildRight" in lines[pieces]
    days = {r.database_name: r.check_days for r in got.collect()}
    assert days == {f"DB{i}": 3 if i == 8 else 5 if str(i).startswith("7") else 1 for i in range(1000)}


def test_no_sets_give_a_warning(spark):
    sets = spark.createDataFrame([], "backup_type string, completion_time timestamp_ntz")
    assert bk.no_backups_warning(bk.latest_by_type(sets)).count() == 1


def test_last_success_messages(spark):
    dbs = spark.createDataFrame([(1, "A"), (2, "B")], "db_key int, name string")
    jobs = spark.createDataFrame([job(1, "DB FULL", "FAILED", 3)], JOB)
    got = {r.name: (r.success_note is None, r.any_note is None, r.last_status) for r in bk.last_success_and_last_any(jobs, dbs).collect()}
    assert got == {"A": (False, True, "FAILED"), "B": (False, False, None)}
