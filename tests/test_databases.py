"""Two databases whose session, resource, container and backup numbers are the same."""

from datetime import datetime

import pytest

from fleetlens.operators import backups, capacity, health, inventory, locks, series, usage
from fleetlens.sinks import tables

NOW = datetime(2024, 1, 10)
DB = "database"


@pytest.fixture
def sessions(spark):
    cols = """database string, sid int, serial int, username string, osuser string, machine string, program string,
      logon_time timestamp_ntz, last_call_et int, type string, paddr int, sql_id int, prev_sql_id int"""
    rows = [(d, s, s, f"{d}{s}", "os", "h", "p", NOW, 600, "USER", s, s, None) for d in "AB" for s in (1, 2)]
    return spark.createDataFrame(rows, cols)


@pytest.fixture
def held(spark):
    # In A session 1 blocks 2; in B both hold and wait elsewhere.
    rows = [("A", 1, 7, 7, 1, 0), ("A", 2, 7, 7, 0, 6), ("B", 1, 8, 8, 1, 0), ("B", 2, 7, 7, 0, 6)]
    return spark.createDataFrame(rows, "database string, sid int, id1 int, id2 int, block int, request int")


@pytest.fixture
def procs(spark):
    return spark.createDataFrame([(d, s, 100 * (d == "B") + s) for d in "AB" for s in (1, 2)], "database string, addr int, spid int")


@pytest.fixture
def statements(spark):
    return spark.createDataFrame([(d, s, f"{d}{s}") for d in "AB" for s in (1, 2)], "database string, sql_id int, sql_text string")


def test_locks(sessions, held, procs, statements):
    waiters = locks.blocked_waiters(held, sessions, DB).collect()
    assert [(r.database, r.holder_sid, r.waiter_sid) for r in waiters] == [("A", 1, 2)]
    edges = {(r.database, r.sid, r.edge) for r in locks.lock_edges(held, sessions, DB).collect()}
    assert edges == {("A", 1, "holds"), ("A", 2, "waits")}
    assert {(r.database, r.sid) for r in locks.blockers(held, sessions, procs, DB).collect()} == {("A", 1), ("B", 1)}
    holders = locks.lock_session_detail(held, sessions, procs, statements, "holder", DB).collect()
    assert [(r.database, r.sid, r.spid, r.sql_text) for r in holders] == [("A", 1, 1, "A1")]
    listed = {(r.database, r.sid, r.spid, r.sql_text) for r in locks.session_sql(sessions, procs, statements, DB).collect()}
    assert listed == {("A", 1, 1, "A1"), ("A", 2, 2, "A2"), ("B", 1, 101, "B1"), ("B", 2, 102, "B2")}
    texts = {r.description for r in locks.session_list(sessions, procs, DB).collect()}
    assert len(texts) == 4 and all(("OSPID:10" in t) == t.startswith("B") for t in texts)


def test_backup_matrix(spark):
    jobs = spark.createDataFrame(
        [(d, 1, NOW, NOW, 1048576.0, "COMPLETED", "DB FULL") for d in "AB"],
        "database string, session_key int, start_time timestamp_ntz, end_time timestamp_ntz, output_bytes double, status string, input_type string",
    )
    details = spark.createDataFrame(
        [("A", 1, 5, 5, "L", None, "NO", 3), ("B", 1, 5, 5, "L", None, "NO", 4)],
        "database string, session_key int, set_stamp int, set_count int, backup_type string, incremental_level int, controlfile_included string, pieces int",
    )
    sets = spark.createDataFrame([("A", 5, 5, "NO"), ("B", 5, 5, "YES")], "database string, set_stamp int, set_count int, input_file_scan_only string")
    output = spark.createDataFrame([("A", 1, 2), ("B", 1, 1)], "database string, session_key int, inst_id int")
    got = {(r.database, r.l, r.inst_id) for r in backups.backup_matrix(jobs, details, sets, output, NOW, by=DB).collect()}
    assert got == {("A", 3, 2), ("B", None, 1)}


def test_accounts_objects_and_queues(spark):
    old = datetime(2020, 1, 1)
    users = spark.createDataFrame([(d, "X", old, "OPEN", "X") for d in "AB"], "database string, name string, ptime timestamp_ntz, account_status string, username string")
    shipped = spark.createDataFrame([("A", "X", "X")], "database string, user_name string, username string")
    assert [r.database for r in health.stale_passwords(users, shipped, NOW, by=DB).collect()] == ["B"]
    assert [r.database for r in health.default_password_users(shipped, users, by=DB).collect()] == ["A"]
    objects = spark.createDataFrame(
        [("A", "O", "N", "TABLE", datetime(2024, 1, 5), old), ("B", "O", "N", "TABLE", datetime(2024, 1, 5), datetime(2024, 1, 5)), ("C", "O", "N", "TABLE", datetime(2024, 1, 5), old)],
        "database string, owner string, object_name string, object_type string, created timestamp_ntz, born timestamp_ntz",
    )
    dropped = spark.createDataFrame([("A", "O", "N"), ("C", "P", "N")], "database string, owner string, object_name string")
    assert [r.database for r in health.recent_objects(objects, dropped, "born", NOW, by=DB).collect()] == ["C"]
    parts = spark.createDataFrame([(d, 1, "c", "AUTOMATIC", "DOWN") for d in "AB"], "database string, queue_id int, component_name string, startup_mode string, component_status string")
    queues = spark.createDataFrame([(d, 1, f"q{d}") for d in "AB"], "database string, queue_id int, queue_name string")
    assert {(r.database, r.queue_name) for r in health.components_down(parts, queues, DB).collect()} == {("A", "qA"), ("B", "qB")}


def test_groups_volumes_and_features(spark):
    groups = spark.createDataFrame([("A", 1, 1048576), ("A", 2, 1), ("B", 1, 2097152), ("B", 3, 1)], "database string, group_no int, bytes long")
    members = spark.createDataFrame([(d, g, f"{d}{g}") for d in "AB" for g in (1, 2, 3)], "database string, group_no int, member string")
    got = {(r.database, r.member, r.size_mb) for r in capacity.group_members(groups, members, DB).collect()}
    assert got == {("A", "'A1'", 1.0), ("B", "'B1'", 2.0)}
    events = spark.createDataFrame([("A", NOW), ("A", NOW), ("B", NOW)], "database string, ts timestamp_ntz")
    sizes = spark.createDataFrame([("A", 1048576), ("B", 5 * 1048576)], "database string, bytes long")
    peaks = {(r.database, r.peak_mb) for r in series.peak_daily_volume(events, sizes, "ts", "bytes", DB).collect()}
    assert peaks == {("A", 2.0), ("B", 5.0)}
    stats = spark.createDataFrame([("A", "f", "12.1", 1, None), ("B", "f", "19.3", 1, None)], "database string, name string, version string, detected_usages int, feature_info string")
    assert {r.database for r in usage.feature_usage(stats, ["f"], {}, by=DB).collect()} == {"A", "B"}
    assert {r.database for r in usage.feature_usage(stats, ["f"], {}).collect()} == {"B"}


def test_reports_keep_the_database(spark):
    soon = datetime(2024, 1, 20)
    users = spark.createDataFrame([(d, "X", "OPEN", soon, "P") for d in "AB"], "database string, username string, account_status string, expiry_date timestamp_ntz, profile string")
    due = health.password_expiry(users, NOW, by=DB)
    assert {r.database for r in due.collect()} == {"A", "B"}
    assert {(r.database, r.message.split()[3]) for r in health.password_expiry_message(due, DB).collect()} == {("A", "1"), ("B", "1")}
    assert {r.database for r in health.service_account_expiry(users, ["X"], NOW, by=DB).collect()} == {"A", "B"}
    jobs = spark.createDataFrame([(d, 1, "u", NOW, "Y", 0, "w") for d in "AB"], "database string, job int, log_user string, last_date timestamp_ntz, broken string, failures int, what string")
    assert {r.database for r in health.broken_jobs(jobs, DB).collect()} == {"A", "B"}
    owners = spark.createDataFrame([("A", "o"), ("A", "o"), ("B", "o")], "database string, owner string")
    assert {(r.database, r.recyclebin_objects) for r in health.count_by_owner(owners, DB).collect()} == {("A", 2), ("B", 1)}
    params = spark.createDataFrame([(d, "log_archive_dest_1", "v", "FALSE") for d in "AB"], "database string, name string, value string, isdefault string")
    assert {r.database for r in health.non_default_parameters(params, DB).collect()} == {"A", "B"}
    assert {r.database for r in health.archive_destinations(params, DB).collect()} == {"A", "B"}
    links = spark.createDataFrame([(d, "o", "l", "u", "h") for d in "AB"], "database string, owner string, db_link string, username string, host string")
    assert {r.database for r in health.link_list(links, DB).collect()} == {"A", "B"}
    audited = spark.createDataFrame([(d, "enable_ddl_logging", "TRUE") for d in "AB"], "database string, name string, value string")
    assert usage.audited_parameters(audited, DB).count() == 2


def test_files_of_groups_with_one_number(spark):
    files = spark.createDataFrame([], "database string, file_name string, bytes long")
    members = spark.createDataFrame([(d, 1, "/r/m") for d in "AB"], "database string, group_no int, member string")
    groups = spark.createDataFrame([("A", 1, 1048576), ("B", 1, 2097152)], "database string, group_no int, bytes long")
    control = spark.createDataFrame([], "database string, file_name string, block_size long, file_size_blocks long")
    found = capacity.all_files(files, files, members, groups, control, DB)
    want = {("A", 1.0), ("B", 2.0)}
    assert {(r.database, r.meg) for r in capacity.size_by_directory(found, DB).collect()} == want
    assert {(r.database, r.meg) for r in capacity.total_size(found, DB).collect()} == want
    assert {(r.database, r.mount_size / 1048576) for r in capacity.size_by_prefix(found, 2, DB).collect()} == want


def test_a_database_that_was_never_sampled(spark):
    rows = [("A", 1, 5, "12", NOW, 3), ("A", 2, 5, "12", None, 0), ("B", 1, 6, "19", None, 0), (None, 1, 7, "19", None, 0)]
    stats = spark.createDataFrame(rows, "database string, con_id int, dbid int, version string, last_sample_date timestamp_ntz, total_samples int")
    got = {(r.database, r.con_id): bool(r.remarks) for r in usage.latest_sample(stats, database=DB).collect()}
    assert got == {("A", 1): False, ("A", 2): False, ("B", 1): True, (None, 1): True}


def test_reported_twice_is_one_inventory_row(spark):
    databases = spark.createDataFrame([("d", "s", 1), ("e", "s", 2)], "database_name string, server string, dbid int")
    servers = spark.createDataFrame([("s", "h")], "server string, physical_server_abbrev string")
    reported = spark.createDataFrame([("d", "h", 7), ("d", "h", 8), ("e", "h", 9), ("e", "h", 9)], "database_name string, host_name string, dbid int")
    duplicates, updated = inventory.identity_reconcile(reported, databases, servers)
    assert sorted(map(tuple, updated.collect())) == [("d", "s", 1), ("e", "s", 9)]
    assert {r.dbid for r in duplicates.collect()} == {9}
    with pytest.raises(Exception, match="repeats a key"):
        tables.update_matching(databases, reported.withColumnRenamed("host_name", "server").replace("h", "s"), ["database_name", "server"], ["dbid"]).collect()
