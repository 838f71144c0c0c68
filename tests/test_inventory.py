from datetime import datetime

import pytest

from fleetlens.operators import inventory as inv
from fleetlens.streaming import operators as st

RULE = (
    "database_name string, sidskip_type string, date_from string, date_to string, hour_from int, minute_from int, "
    "hour_to int, minute_to int, sidskip_notes string, disabled string"
)
DAILY = ("DB", "DAILY", "2015-08-10", "2016-08-10", 23, 0, None, None, "n", "N")
TUESDAY = ("DB", "TUESDAY", "2015-08-10", None, None, None, None, None, "n", "N")
SUNDAY = ("DB", "SUNDAY", None, None, 17, 59, None, None, "n", "N")
MONDAY = ("DB", "MONDAY", None, None, None, None, 5, 0, "n", "N")
FIRST = ("DB", "1", None, None, 19, 14, None, None, "n", "N")
SECOND = ("DB", "2", None, None, None, None, 6, 0, "n", "N")


@pytest.mark.parametrize(
    "rule,moment,skipped",
    [
        (DAILY, datetime(2015, 9, 1, 23, 30), True),
        (DAILY, datetime(2015, 9, 1, 22, 59), False),
        (DAILY, datetime(2017, 1, 1, 23, 30), False),
        (TUESDAY, datetime(2015, 8, 11, 12, 0), True),
        (TUESDAY, datetime(2015, 8, 12, 12, 0), False),
        (SUNDAY, datetime(2024, 1, 7, 18, 0), True),
        (SUNDAY, datetime(2024, 1, 7, 17, 58), False),
        (MONDAY, datetime(2024, 1, 8, 5, 0), True),
        (MONDAY, datetime(2024, 1, 8, 5, 1), False),
        (FIRST, datetime(2024, 1, 1, 19, 14), True),
        (FIRST, datetime(2024, 1, 1, 19, 13), False),
        (SECOND, datetime(2024, 1, 2, 0, 0), True),
        (SECOND, datetime(2024, 1, 2, 6, 1), False),
        ((*DAILY[:-1], "Y"), datetime(2015, 9, 1, 23, 30), False),
    ],
)
def test_blackout_rules(spark, rule, moment, skipped):
    rules = spark.createDataFrame([rule], RULE)
    dbs = spark.createDataFrame([("DB", "N"), ("OTHER", "Y")], "database_name string, disabled string")
    got = {r.database_name for r in inv.blackouts(rules, dbs, moment).collect()}
    assert got == ({"DB", "OTHER"} if skipped else {"OTHER"})
    left = {r.database_name for r in inv.not_blacked_out(dbs, rules, moment).collect()}
    assert left == ({"OTHER"} if skipped else {"DB", "OTHER"})


def test_rows_in_blackout_use_their_own_time(spark):
    rules = spark.createDataFrame([FIRST], RULE)
    rows = spark.createDataFrame(
        [("DB", datetime(2024, 1, 1, 20)), ("DB", datetime(2024, 1, 2, 20)), ("X", datetime(2024, 1, 1, 20))],
        "database_name string, ts timestamp_ntz",
    )
    assert inv.rows_in_blackout(rows, rules, "ts").count() == 1
    assert inv.rows_in_blackout(rows, rules, "ts", inside=False).count() == 2


def test_indicator_arguments(spark):
    df = spark.createDataFrame([("a", "Y"), ("b", "N")], "name string, production_ind string")
    assert inv.indicator_filter(df, {"production_ind": "Y"}).count() == 1
    with pytest.raises(ValueError):
        inv.indicator_filter(df, {"nothing": "Y"})
    with pytest.raises(ValueError):
        inv.indicator_filter(df, {"production_ind": "maybe"})


def test_mixed_environment_equals_exists(spark, rows_of):
    import random

    rng = random.Random(3)
    dbs = [(f"d{rng.randrange(30)}", f"s{rng.randrange(12)}", "N", rng.choice("YN")) for _ in range(40)]
    frame = spark.createDataFrame(dbs, "database_name string, server string, disabled string, production_ind string")
    servers = spark.createDataFrame([(f"s{i}", f"h{i // 2}", "N") for i in range(12)], "server string, physical_server_abbrev string, disabled string")
    placed = [(f"h{int(s[1:]) // 2}", d, p) for d, s, _, p in dbs]
    want = {a for a in placed if any(b[0] == a[0] and b[1] != a[1] and b[2] != a[2] for b in placed)}
    assert rows_of(inv.mixed_environment(frame, servers)) == want


def test_placement_drift(spark):
    servers = spark.createDataFrame([("h1", "A", "N"), ("h2", "B", "N"), ("h3", "A", "N"), ("h4", None, "N")],
        "physical_server_abbrev string, cluster_name string, disabled string")
    vms = spark.createDataFrame([("H1", "A"), ("H2", "A"), ("H3", "Z")], "virtual_machine string, cluster_name string")
    got = {(r.physical_server_abbrev, r.cluster_notes) for r in inv.placement_drift(servers, vms).collect()}
    assert got == {("h2", "WARNING: Known Cluster"), ("h3", "ERROR: Unknown Cluster!")}


def test_host_label_and_reconcile(spark):
    servers = spark.createDataFrame([("a1", "h1", "C", "N"), ("h2", "h2", None, "N")],
        "server string, physical_server_abbrev string, cluster_name string, disabled string")
    dbs = spark.createDataFrame([("D1", "a1", "N", 1), ("D2", "h2", "N", 2)], "database_name string, server string, disabled string, dbid int")
    labels = {r.database_name: r.host_label for r in inv.active_targets(dbs, servers).collect()}
    assert labels == {"D1": "a1 (h1) [C] ", "D2": "h2"}
    reported = spark.createDataFrame([("D1", "h1", 7), ("D2", "h1", 7)], "database_name string, host_name string, dbid int")
    duplicates, updated = inv.identity_reconcile(reported, dbs, servers)
    assert duplicates.count() == 2
    assert {r.database_name: r.dbid for r in updated.collect()} == {"D1": 7, "D2": 2}


def test_orphans_survive_a_null_server(spark):
    servers = spark.createDataFrame([("s1", "s1", "N"), ("s2", "s2", "N"), ("al", "s1", "N")], "server string, physical_server_abbrev string, disabled string")
    dbs = spark.createDataFrame([("s1", "N"), (None, "N")], "server string, disabled string")
    assert [r.server for r in inv.orphan_servers(servers, dbs).collect()] == ["s2"]


def test_validate_null_passes_checks(spark):
    df = spark.createDataFrame([(1, "Y", 5.0), (1, "X", 500.0), (2, None, None)], "id int, flag string, v double")
    parent = spark.createDataFrame([(1,)], "id int")
    got = inv.validate(df, ["id"], domains={"flag": ["Y", "N"]}, ranges={"v": (0, 100)}, not_null=["v"], unique=[["id"]], references={"id": (parent, "id")})
    assert sorted((r.rule, r.row_key) for r in got.collect()) == [
        ("domain flag", "1"), ("not null v", "2"), ("range v", "1"), ("reference id", "2"), ("unique id", "1"),
    ]


def test_version_ranges_are_open(spark):
    checks = spark.createDataFrame(
        [("A", None, None), ("B", None, 1100), ("C", 1101, None), ("D", 2000, 2**31 - 1)], "script_id string, db_version_from int, db_version_to int"
    ).selectExpr(
        "*", "'N' AS run_on_master", "'D' AS frequency", "'CHECK' AS script_type", "'N' AS disabled", "script_id AS script_name",
        "'' AS param1", "'' AS param2", "1 AS run_order",
    )
    stamps = "CAST(NULL AS TIMESTAMP_NTZ)"
    none = checks.limit(0)
    adds = none.selectExpr("'x' AS database_name", "script_id", "frequency", "script_type", "disabled", "run_order", f"{stamps} AS added_from", f"{stamps} AS added_to")
    skips = none.selectExpr("'x' AS database_name", "script_id", "disabled", f"{stamps} AS skipped_from", f"{stamps} AS skipped_to")
    targets = spark.createDataFrame([("old", 1010), ("new", 2326), ("unknown", None)], "database_name string, version int")
    got = {(r.database_name, r.script.strip()) for r in inv.checks_to_run(checks, adds, skips, targets, "2024-01-01").collect()}
    assert got == {("old", "A"), ("old", "B"), ("new", "A"), ("new", "C"), ("new", "D")}


def test_blackout_days_join_overlapping_spans(spark):
    rules = spark.createDataFrame(
        [
            ("d", "DAILY", None, None, 8, 0, 9, 0, "a", "N"), ("d", "MONDAY", None, None, 8, 30, 10, 0, "b", "N"),
            ("d", "15", None, None, 10, 1, 10, 30, "c", "N"), ("d", "DAILY", None, None, 20, 0, 20, 0, "d", "N"),
            ("d", "DAILY", None, None, 12, 0, 13, 0, "off", "Y"), ("d", "DAILY", "2024-02-01", None, None, None, None, None, "later", "N"),
            ("d", "DAILY", None, None, 23, 0, 1, 0, "never", "N"),
        ],
        "database_name string, sidskip_type string, date_from string, date_to string, hour_from int, minute_from int, hour_to int, minute_to int, sidskip_notes string, disabled string",
    )
    days = spark.sql("SELECT 'd' AS database_name, DATE '2024-01-15' AS day UNION ALL SELECT 'd', DATE '2024-01-16'")
    got = {r.day.day: [tuple(s) for s in r.spans] for r in inv.blackout_days(days, rules).collect()}
    assert got == {15: [(480, 630), (1200, 1200)], 16: [(480, 540), (1200, 1200)]}
    rows = spark.sql("SELECT 'd' AS database_name, TIMESTAMP_NTZ '2024-01-15 10:30:59' AS ts UNION ALL SELECT 'd', TIMESTAMP_NTZ '2024-01-15 10:31:00' UNION ALL SELECT NULL, TIMESTAMP_NTZ '2024-01-15 08:00:00'")
    assert [r.ts.minute for r in inv.rows_in_blackout(rows, rules, "ts").collect()] == [30]
    assert inv.rows_in_blackout(rows, rules, "ts", inside=False).count() == 2


def test_version_ranges(spark):
    cols = "script_id string, script_name string, script_type string, db_version_from int, db_version_to int, frequency string, disabled string, run_order int, param1 string, run_on_master string, param2 string"
    ranges = {"all": (None, None), "from": (11, None), "upto": (None, 11), "one": (12, 12), "none": (13, 12), "gap": (10, 10)}
    checks = spark.createDataFrame([(n, n, "CHECK", lo, hi, "D", "N", 1, None, "N", None) for n, (lo, hi) in ranges.items()], cols)
    adds = spark.createDataFrame([], "script_id string, database_name string, added_from timestamp_ntz, added_to timestamp_ntz, disabled string, run_order int, script_type string, frequency string")
    skips = spark.createDataFrame([], "script_id string, database_name string, skipped_from timestamp_ntz, skipped_to timestamp_ntz, disabled string")
    targets = spark.createDataFrame([("a", 9), ("b", 11), ("c", 12), ("d", 19), ("e", None)], "database_name string, version int")
    got = {(r.database_name, r.script.strip()) for r in inv.checks_to_run(checks, adds, skips, targets, "2024-01-01").collect()}
    want = {(d, n) for d, v in (("a", 9), ("b", 11), ("c", 12), ("d", 19)) for n, (lo, hi) in ranges.items() if (lo or 0) <= v <= (hi or 99)}
    assert got == want


def test_gate_counts_and_holds_back(spark, tmp_path):
    rows = spark.createDataFrame([(1, "F", 5), (2, "X", 500), (3, None, None), (4, "F", 501)], "id int, status string, amount int")
    rules = {"domains": {"status": ["F"]}, "ranges": {"amount": (0, 100)}, "not_null": ["status"]}
    path = str(tmp_path / "gate")
    assert inv.gated_write(rows, path, "id", **rules) == {"rows": 4, "domain status": 1, "range amount": 2, "not null status": 1}
    assert [r.id for r in inv.accepted(spark, path, rows).collect()] == [1]
    held = sorted(map(tuple, inv.quarantined(spark, path, rows).collect()), key=str)
    assert held == sorted(map(tuple, inv.validate(rows, "id", **rules).collect()), key=str)


def test_gate_within_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "F" if i % 3 else "X") for i in range(30)], "id int, status string")
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    counts = []

    def store(batch, number):
        counts.append(inv.gated_write(batch, f"{tmp_path}/out/batch={number}", "id", domains={"status": ["F"]}))

    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    st.drain(stream, store, str(tmp_path / "ckpt"))
    assert sum(c["rows"] for c in counts) == 30 and sum(c["domain status"] for c in counts) == 10
    assert inv.accepted(spark, str(tmp_path / "out"), rows).count() == 20
    assert inv.quarantined(spark, str(tmp_path / "out"), rows).count() == 10
