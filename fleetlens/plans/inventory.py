"""Inventory and topology queries over the driver tables."""

from pyspark.sql import functions as F

from fleetlens.operators import inventory as inv
from fleetlens.plans.capacity import FLEET_SQL, fleet
from fleetlens.plans.registry import AS_OF, EVENT_NOW, query, sql_values
from fleetlens.plans.tables import scratch


@query(
    "v01_active_targets",
    f"""WITH {FLEET_SQL} SELECT database_name, d.server, s.server || ' (' || physical_server_abbrev || ')'
      || CASE WHEN cluster_name IS NULL THEN '' ELSE ' [' || cluster_name || '] ' END AS host_label
    FROM d JOIN s ON d.server = s.server WHERE d.disabled <> 'Y' AND s.disabled <> 'Y'""",
)
def v01(t):
    return inv.active_targets(*fleet(t))


# database is the customer's market segment or name; as_of is Tuesday 30 January 2024, 23:59
RULES = [
    ("MACHINERY", "DAILY", "2023-08-10", "2024-08-10", 23, 0, None, None, "nightly", "N"),
    ("BUILDING", "TUESDAY", "2023-08-10", None, None, None, None, None, "tuesdays", "N"),
    ("FURNITURE", "SUNDAY", None, None, 17, 59, None, None, "sunday evening", "N"),
    ("HOUSEHOLD", "30", None, None, 19, 14, None, None, "month end", "N"),
    ("HOUSEHOLD", "1", None, None, None, None, 6, 0, "first morning", "N"),
    ("AUTOMOBILE", "DAILY", None, None, None, None, None, None, "switched off", "Y"),
]
RULE_COLS = (
    "database_name, sidskip_type, date_from, date_to, hour_from, minute_from, hour_to, minute_to, sidskip_notes, disabled"
)
RULE_SQL = f"r AS (SELECT * FROM (VALUES {sql_values(RULES)}) v({RULE_COLS}))"


def rule_table(t):
    text = "database_name string, sidskip_type string, date_from string, date_to string"
    return t.rows(
        RULES,
        f"{text}, hour_from int, minute_from int, hour_to int, minute_to int, sidskip_notes string, disabled string",
    )


def rule_sql(ts: str) -> str:
    return f"""sidskip_type IN ('DAILY', upper(strftime({ts}, '%A')), CAST(day({ts}) AS VARCHAR))
      AND (date_from IS NULL OR CAST(date_from AS DATE) <= CAST({ts} AS DATE))
      AND (date_to IS NULL OR CAST(date_to AS DATE) >= CAST({ts} AS DATE))
      AND 60 * coalesce(hour_from, 0) + coalesce(minute_from, 0) <= 60 * hour({ts}) + minute({ts})
      AND 60 * coalesce(hour_to, 23) + coalesce(minute_to, 59) >= 60 * hour({ts}) + minute({ts})
      AND r.disabled <> 'Y'"""


def segments(t):
    return t.customer.select(
        F.col("c_custkey"),
        F.col("c_mktsegment").alias("database_name"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )


@query(
    "v02_blackouts",
    f"""WITH {RULE_SQL} SELECT database_name, sidskip_notes AS reason FROM r WHERE {rule_sql(EVENT_NOW)}
    UNION ALL SELECT c_mktsegment, '(skipped as database marked as disabled)' FROM customer WHERE c_acctbal < 0""",
)
def v02(t):
    return inv.blackouts(rule_table(t), segments(t), AS_OF)


@query(
    "v02_not_blacked_out",
    f"""WITH {RULE_SQL} SELECT c_custkey, c_mktsegment AS database_name FROM customer
    WHERE c_mktsegment NOT IN (SELECT database_name FROM r WHERE {rule_sql(EVENT_NOW)})""",
)
def v02_anti(t):
    return inv.not_blacked_out(segments(t).drop("disabled"), rule_table(t), AS_OF)


@query(
    "v02_rows_in_blackout",
    f"""WITH {RULE_SQL} SELECT event_id, c_mktsegment AS database_name, ts FROM events JOIN customer ON c_custkey = user_id
    WHERE EXISTS (SELECT 1 FROM r WHERE database_name = c_mktsegment AND {rule_sql('ts')})""",
)
def v02_rows(t):
    rows = t.events.join(t.customer, F.col("c_custkey") == F.col("user_id")).select(
        "event_id", F.col("c_mktsegment").alias("database_name"), "ts"
    )
    return inv.rows_in_blackout(rows, rule_table(t), "ts")


@query(
    "v03_indicator_filter",
    f"WITH {FLEET_SQL} SELECT database_name, server FROM d WHERE production_ind = 'Y' AND disabled = 'N'",
)
def v03(t):
    rows = inv.indicator_filter(fleet(t)[0], {"production_ind": "Y", "disabled": "N"})
    return rows.select("database_name", "server")


# script_id, name, type, from, to, frequency, disabled, run_order, param1, on_master, param2
CHECKS = [
    ("SPACE", "space_check", "CHECK", None, None, "DWM", "N", 10, None, "N", None),
    ("SUMM", "space_summary", "SUMMARY", 92, None, "DW", "N", 20, "%", "N", "90"),
    ("BACKUP", "backup_check", "CHECK", 102, 112, "D", "N", 30, None, "N", None),
    ("LOCKS", "lock_check", "CHECK", 121, None, "D", "N", 40, None, "N", None),
    ("OFF", "old_check", "CHECK", None, None, "D", "Y", 50, None, "N", None),
    ("MASTER", "fleet_check", "CHECK", None, None, "D", "N", 60, None, "Y", None),
    ("WEEKLY", "weekly_check", "CHECK", None, None, "W", "N", 70, None, "N", None),
]
CHECK_COLS = (
    "script_id, script_name, script_type, db_version_from, db_version_to, frequency, disabled, run_order, "
    "param1, run_on_master, param2"
)
# script_id, database (market segment), from, to, disabled, run_order, type, frequency
ADDS = [
    ("OFF", "BUILDING", None, None, "N", 5, "CHECK", "D"),
    ("BACKUP", "MACHINERY", "2024-01-01 00:00:00", "2024-01-15 00:00:00", "N", 6, "CHECK", "D"),
    ("LOCKS", "FURNITURE", "2024-01-01 00:00:00", None, "N", 7, "CHECK", "DW"),
]
ADD_COLS = "script_id, database_name, added_from, added_to, disabled, run_order, script_type, frequency"
SKIPS = [
    ("SPACE", "HOUSEHOLD", None, None, "N"),
    ("LOCKS", "HOUSEHOLD", "2024-01-01 00:00:00", None, "N"),
    ("SUMM", "FURNITURE", None, "2024-01-15 00:00:00", "N"),
    ("SPACE", "AUTOMOBILE", None, None, "Y"),
    ("OFF", "BUILDING", None, "2023-01-01 00:00:00", "N"),
]
SKIP_COLS = "script_id, database_name, skipped_from, skipped_to, disabled"
CHECK_SQL = f"""k AS (SELECT * FROM (VALUES {sql_values(CHECKS)}) v({CHECK_COLS})),
    a AS (SELECT * REPLACE (CAST(added_from AS TIMESTAMP) AS added_from, CAST(added_to AS TIMESTAMP) AS added_to)
      FROM (VALUES {sql_values(ADDS)}) v({ADD_COLS})),
    x AS (SELECT * REPLACE (CAST(skipped_from AS TIMESTAMP) AS skipped_from, CAST(skipped_to AS TIMESTAMP) AS skipped_to)
      FROM (VALUES {sql_values(SKIPS)}) v({SKIP_COLS})),
    f AS (SELECT script_id, database_name FROM x WHERE disabled <> 'Y'
      AND coalesce(skipped_from, {EVENT_NOW}) <= {EVENT_NOW} AND coalesce(skipped_to, {EVENT_NOW}) >= {EVENT_NOW}),
    g AS (SELECT * FROM a WHERE disabled <> 'Y'
      AND coalesce(added_from, {EVENT_NOW}) <= {EVENT_NOW} AND coalesce(added_to, {EVENT_NOW}) >= {EVENT_NOW})"""


def check_tables(t):
    checks = t.rows(
        CHECKS,
        "script_id string, script_name string, script_type string, db_version_from int, db_version_to int, "
        "frequency string, disabled string, run_order int, param1 string, run_on_master string, param2 string",
    )
    adds = t.rows(
        ADDS,
        "script_id string, database_name string, added_from string, added_to string, disabled string, "
        "run_order int, script_type string, frequency string",
    )
    skips = t.rows(SKIPS, "script_id string, database_name string, skipped_from string, skipped_to string, disabled string")
    for c in ("added_from", "added_to"):
        adds = adds.withColumn(c, F.col(c).cast("timestamp_ntz"))
    for c in ("skipped_from", "skipped_to"):
        skips = skips.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return checks, adds, skips


def per_customer(t, df):
    """Rule rows of a market segment, repeated for each of its customers."""
    names = t.customer.select("c_name", F.col("c_mktsegment").alias("database_name"))
    return df.join(names, "database_name").drop("database_name").withColumnRenamed("c_name", "database_name")


@query(
    "v04_checks_to_run",
    f"""WITH {CHECK_SQL}, t AS (SELECT c_name AS db, c_mktsegment AS seg, c_nationkey + 100 AS version FROM customer),
    due AS (SELECT db, seg, script_id, run_order, frequency, script_type FROM k JOIN t ON disabled <> 'Y'
        AND version BETWEEN coalesce(db_version_from, version) AND coalesce(db_version_to, version)
      UNION ALL SELECT db, seg, script_id, run_order, frequency, script_type FROM g JOIN t ON seg = database_name),
    kept AS (SELECT due.* FROM due LEFT JOIN f ON f.script_id = due.script_id AND database_name = seg
      WHERE f.script_id IS NULL AND contains(due.frequency, 'D') AND due.script_type IN ('CHECK', 'SUMMARY'))
    SELECT DISTINCT db AS database_name, concat(script_name, ' ', param1, ' ', param2) AS script, kept.run_order
    FROM kept JOIN k ON k.script_id = kept.script_id WHERE run_on_master = 'N'""",
)
def v04(t):
    checks, adds, skips = check_tables(t)
    targets = t.customer.select(
        F.col("c_name").alias("database_name"), (F.col("c_nationkey") + 100).cast("int").alias("version")
    )
    return inv.checks_to_run(
        checks, per_customer(t, adds), per_customer(t, skips), targets, AS_OF, types=["CHECK", "SUMMARY"]
    )


@query(
    "v05_skipped_checks",
    f"""WITH {CHECK_SQL}, w AS (SELECT x.script_id, c_name AS database_name FROM x JOIN customer ON c_mktsegment = x.database_name
      WHERE x.disabled <> 'Y' AND x.database_name NOT IN (SELECT database_name FROM g))
    SELECT w.database_name, script_id || '(' || script_type || ')' AS skipped FROM w JOIN k USING (script_id)""",
)
def v05(t):
    checks, adds, skips = check_tables(t)
    return inv.skipped_checks(per_customer(t, skips), checks, per_customer(t, adds), AS_OF)


SETS = [("MORNING", None, "N"), ("EVENING", "Evening set", "N")]
PARTS = [
    ("EVENING", "SPACE", None, "N"),
    ("EVENING", "SUMM", None, "N"),
    ("EVENING", "BACKUP", "Customer#000000005", "N"),
    ("EVENING", "SPACE", "Customer#000000006", "N"),
    ("EVENING", "LOCKS", None, "Y"),
    ("MORNING", "LOCKS", None, "N"),
]


@query(
    "v06_resolve_check_set",
    f"""WITH {FLEET_SQL}, {CHECK_SQL}, z AS (SELECT * FROM (VALUES {sql_values(SETS)}) v(set_id, title, disabled)),
    p AS (SELECT * FROM (VALUES {sql_values(PARTS)}) v(set_id, script_id, database_name, disabled))
    SELECT DISTINCT d.database_name, script_name, translate(coalesce(title, z.set_id), ' ', '_') AS title,
      coalesce(param1, 'null') AS param1, coalesce(param2, 'null') AS param2
    FROM d JOIN s ON d.server = s.server, z JOIN p ON p.set_id = z.set_id JOIN k ON k.script_id = p.script_id
    WHERE (p.database_name IS NULL OR p.database_name = d.database_name) AND z.set_id = 'EVENING'
      AND d.disabled <> 'Y' AND s.disabled <> 'Y' AND z.disabled <> 'Y' AND p.disabled <> 'Y'""",
)
def v06(t):
    sets = t.rows(SETS, "set_id string, title string, disabled string")
    parts = t.rows(PARTS, "set_id string, script_id string, database_name string, disabled string")
    return inv.resolve_check_set(sets, parts, check_tables(t)[0], *fleet(t), "EVENING")


@query(
    "v07_duplicate_ids",
    f"""WITH {FLEET_SQL} SELECT dbid, database_name FROM d
    WHERE dbid IN (SELECT dbid FROM d WHERE dbid IS NOT NULL GROUP BY dbid HAVING count(*) > 1)""",
)
def v07(t):
    return inv.duplicate_ids(fleet(t)[0], "dbid", ["database_name"])


@query(
    "v08_mixed_environment",
    f"""WITH {FLEET_SQL}, j AS (SELECT physical_server_abbrev, database_name, production_ind FROM d JOIN s ON d.server = s.server
      WHERE d.disabled <> 'Y' AND s.disabled <> 'Y')
    SELECT * FROM j WHERE EXISTS (SELECT 1 FROM j o WHERE o.physical_server_abbrev = j.physical_server_abbrev
      AND o.database_name <> j.database_name AND o.production_ind <> j.production_ind)""",
)
def v08(t):
    return inv.mixed_environment(*fleet(t))


PLACE_SQL = """p AS (SELECT s_name AS physical_server_abbrev, 'NATION_' || ((s_nationkey + s_suppkey % 2) % 20) AS cluster_name,
      CASE WHEN s_acctbal < 0 THEN 'Y' ELSE 'N' END AS disabled FROM supplier),
    m AS (SELECT upper(s_name) AS virtual_machine, 'NATION_' || s_nationkey AS cluster_name FROM supplier)"""


def placements(t):
    expected = F.concat(F.lit("NATION_"), (F.col("s_nationkey") + F.col("s_suppkey") % 2) % 20)
    servers = t.supplier.select(
        F.col("s_name").alias("physical_server_abbrev"),
        expected.alias("cluster_name"),
        F.when(F.col("s_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )
    vms = t.supplier.select(
        F.upper("s_name").alias("virtual_machine"), F.concat(F.lit("NATION_"), "s_nationkey").alias("cluster_name")
    )
    return servers, vms


@query(
    "v09_placement_drift",
    f"""WITH {PLACE_SQL}, e AS (SELECT physical_server_abbrev AS host, cluster_name AS old_cluster FROM p WHERE disabled <> 'Y' AND cluster_name IS NOT NULL),
    seat AS (SELECT host, old_cluster, m.cluster_name AS new_cluster,
      bool_or(m.cluster_name = old_cluster) OVER (PARTITION BY host, old_cluster) AS settled FROM e JOIN m ON virtual_machine = upper(host)),
    known AS (SELECT DISTINCT old_cluster AS cluster FROM e)
    SELECT host AS physical_server_abbrev, old_cluster, new_cluster,
      if(cluster IS NULL, 'ERROR: Unknown Cluster!', 'WARNING: Known Cluster') AS cluster_notes
    FROM seat LEFT JOIN known ON cluster = new_cluster WHERE NOT settled""",
)
def v09(t):
    return inv.placement_drift(*placements(t))


@query(
    "v10_cluster_counts",
    f"""WITH {FLEET_SQL}, n AS (SELECT server, count(*) AS n FROM d WHERE disabled <> 'Y' GROUP BY server)
    SELECT coalesce(cluster_name, '(No cluster)') AS cluster_name, count(DISTINCT physical_server_abbrev) AS server_count,
      CAST(sum(n) AS BIGINT) AS instance_count FROM s LEFT JOIN n USING (server) WHERE disabled <> 'Y' GROUP BY ALL""",
)
def v10(t):
    return inv.cluster_counts(*fleet(t))


@query(
    "v11_cluster_members",
    f"""WITH {PLACE_SQL}, u AS (SELECT DISTINCT physical_server_abbrev AS h, coalesce(cluster_name, '(No Cluster)') AS c
      FROM p WHERE disabled <> 'Y')
    SELECT c AS cluster_name, h AS member FROM u""",
)
def v11(t):
    return inv.cluster_members(placements(t)[0])


ORPHAN_SQL = """o AS (SELECT c_name AS server, CASE WHEN c_nationkey = 0 THEN c_mktsegment ELSE c_name END AS host,
      CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS disabled FROM customer),
    u AS (SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') AS server,
      CASE WHEN event_type = 'error' THEN 'Y' ELSE 'N' END AS disabled FROM events)"""


@query(
    "v12_orphan_servers",
    f"""WITH {ORPHAN_SQL} SELECT server FROM o WHERE disabled <> 'Y'
      AND server NOT IN (SELECT server FROM u WHERE disabled <> 'Y')
    EXCEPT SELECT server FROM o WHERE host <> server""",
)
def v12(t):
    servers = t.customer.select(
        F.col("c_name").alias("server"),
        F.when(F.col("c_nationkey") == 0, F.col("c_mktsegment")).otherwise(F.col("c_name")).alias("physical_server_abbrev"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )
    databases = t.events.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("server"),
        F.when(F.col("event_type") == "error", "Y").otherwise("N").alias("disabled"),
    )
    return inv.orphan_servers(servers, databases)


@query(
    "v13_names_not_listed",
    "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)",
)
def v13(t):
    return inv.names_not_listed(
        t.customer.select(F.col("c_custkey").alias("id")), t.events.select(F.col("user_id").alias("id")), "id"
    )


@query(
    "v14_ping_targets",
    f"""WITH {FLEET_SQL} SELECT DISTINCT physical_server FROM s WHERE disabled <> 'Y' AND ping_disabled <> 'Y'
      AND (upper(server) LIKE '%A%' OR upper(physical_server_abbrev) LIKE '%A%')""",
)
def v14(t):
    return inv.ping_targets(fleet(t)[1], "%A%")


@query(
    "v15_instance_labels",
    """SELECT DISTINCT 'NATION_' || c_nationkey || CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE '++' || c_mktsegment END
      AS label FROM customer WHERE c_acctbal >= 0""",
)
def v15(t):
    instances = t.customer.select(
        F.concat(F.lit("NATION_"), "c_nationkey").alias("server"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("instance_name"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )
    return inv.instance_labels(instances)


@query(
    "v16_app_databases",
    """SELECT c_name AS db_name, 'NATION_' || c_nationkey AS server, c_mktsegment AS instance_name, 'N' AS disabled FROM customer c
    WHERE c_acctbal >= 0 AND NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = c_nationkey AND s_acctbal >= 0
      AND c_mktsegment = CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END)""",
)
def v16(t):
    databases = t.customer.select(
        F.col("c_name").alias("db_name"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("server"),
        F.col("c_mktsegment").alias("instance_name"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )
    skips = t.supplier.select(
        F.concat(F.lit("NATION_"), "s_nationkey").alias("server"),
        F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("instance_name"),
        F.when(F.col("s_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
    )
    return inv.app_databases(databases, skips)


@query(
    "v17_alias_to_physical",
    f"""WITH {FLEET_SQL} SELECT lower('NATION_' || s_nationkey) || '' AS alias, physical_server
    FROM supplier JOIN s ON lower(s.server) = lower('NATION_' || s_nationkey)""",
)
def v17(t):
    aliases = t.supplier.select(F.lower(F.concat(F.lit("NATION_"), "s_nationkey")).alias("alias"))
    return inv.alias_to_physical(aliases, fleet(t)[1])


# Some databases are reported twice, with one id or with two.
REPORT_SQL = """rep AS (SELECT c_name AS database_name, r_name AS host_name, c_custkey % 700 + CASE WHEN c_custkey % 9 = 0 THEN n ELSE 0 END AS dbid
      FROM customer JOIN region ON r_regionkey = c_custkey % 5 CROSS JOIN range(2) x(n) WHERE n = 0 OR c_custkey % 3 = 0)"""


def reported(t):
    key = F.col("c_custkey")
    times = F.when(key % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = t.customer.join(t.region, F.col("r_regionkey") == key % 5).withColumn("n", F.explode(times))
    dbid = key % 700 + F.when(key % 9 == 0, F.col("n")).otherwise(0)
    return rows.select(F.col("c_name").alias("database_name"), F.col("r_name").alias("host_name"), dbid.alias("dbid"))


@query(
    "v18_reported_duplicates",
    f"""WITH {REPORT_SQL} SELECT dbid, database_name, host_name FROM rep
    WHERE dbid IN (SELECT dbid FROM rep GROUP BY dbid HAVING count(*) > 1)""",
)
def v18_duplicates(t):
    return inv.identity_reconcile(reported(t), *fleet(t))[0]


@query(
    "v18_identity_reconcile",
    f"""WITH {FLEET_SQL}, {REPORT_SQL}, b AS (SELECT rep.database_name, d.server, any_value(rep.dbid) AS dbid FROM rep
      JOIN d USING (database_name) JOIN s ON s.server = d.server AND physical_server_abbrev = host_name
      GROUP BY rep.database_name, d.server HAVING count(DISTINCT rep.dbid) = 1)
    SELECT d.* REPLACE (CASE WHEN b.database_name IS NULL THEN d.dbid ELSE b.dbid END AS dbid)
    FROM d LEFT JOIN b ON b.database_name = d.database_name AND b.server = d.server""",
)
def v18(t):
    return inv.identity_reconcile(reported(t), *fleet(t))[1]


@query(
    "v19_types_present",
    """SELECT count(*) AS type_count FROM (SELECT p_type AS k FROM part UNION ALL SELECT c_mktsegment FROM customer)
    WHERE k = 'PROMO'""",
)
def v19(t):
    return inv.types_present(
        t.part.select(F.col("p_type").alias("script_type")), t.customer.select(F.col("c_mktsegment").alias("script_type")), "PROMO"
    )


@query(
    "v20_validate",
    """SELECT 'domain o_orderstatus' AS rule, CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS value FROM orders
      WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'range o_totalprice', CAST(o_orderkey AS VARCHAR), CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
      FROM orders WHERE NOT (o_totalprice BETWEEN 10000 AND 400000)
    UNION ALL SELECT 'not null parent', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_custkey % 11 = 0
    UNION ALL SELECT 'unique o_custkey,o_orderdate', o_custkey || '|' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S'),
      CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1
    UNION ALL SELECT 'reference o_custkey', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders
      WHERE o_custkey NOT IN (SELECT user_id FROM events)""",
)
def v20(t):
    orders = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")).withColumn(
        "parent", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey"))
    )
    return inv.validate(
        orders,
        ["o_orderkey"],
        domains={"o_orderstatus": ["F", "O"]},
        ranges={"o_totalprice": (10000, 400000)},
        not_null=["parent"],
        unique=[["o_custkey", "o_orderdate"]],
        references={"o_custkey": (t.events, "user_id")},
    )


@query(
    "v20_gated_write",
    """SELECT 'domain o_orderstatus' AS rule, CAST(o_orderkey AS VARCHAR) AS row_key, o_orderstatus AS value FROM orders
      WHERE o_orderstatus NOT IN ('F', 'O')
    UNION ALL SELECT 'range o_custkey', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders WHERE o_custkey > 900
    UNION ALL SELECT 'not null parent', CAST(o_orderkey AS VARCHAR), NULL FROM orders WHERE o_custkey % 11 = 0
    UNION ALL SELECT 'accepted', NULL, CAST(count(*) AS VARCHAR) FROM orders
      WHERE o_orderstatus IN ('F', 'O') AND o_custkey <= 900 AND o_custkey % 11 <> 0""",
)
def v20_gate(t):
    orders = t.orders.withColumn("parent", F.when(F.col("o_custkey") % 11 != 0, F.col("o_custkey")))
    path = scratch(t, "gate")
    inv.gated_write(
        orders, path, "o_orderkey", domains={"o_orderstatus": ["F", "O"]}, ranges={"o_custkey": (0, 900)}, not_null=["parent"]
    )
    passed = inv.accepted(t.spark, path, orders).agg(F.count(F.lit(1)).cast("string").alias("value"))
    passed = passed.select(F.lit("accepted").alias("rule"), F.lit(None).cast("string").alias("row_key"), "value")
    return inv.quarantined(t.spark, path, orders).unionByName(passed)
