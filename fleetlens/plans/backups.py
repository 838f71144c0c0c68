"""Backup queries: orders as jobs, lineitems as backup sets, customers as databases."""

from pyspark.sql import functions as F

from fleetlens.operators import backups as bk
from fleetlens.plans.registry import ORDER_NOW, ORDERS_AS_OF, query, sql_values

KINDS = {"1": "DB FULL", "2": "DB INCR", "3": "ARCHIVELOG", "4": "DB FULL", "5": "DATAFILE"}
STATES = {"F": "COMPLETED", "P": "FAILED", "O": "RUNNING"}


def lookup(mapping, c):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), c)


def jobs(t):
    named = t.customer.select("c_custkey", F.col("c_name").alias("db_name"))
    return t.orders.join(named, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_custkey").alias("db_key"),
        "db_name",
        F.col("o_orderkey").alias("session_key"),
        lookup(KINDS, F.substring("o_orderpriority", 1, 1)).alias("input_type"),
        lookup(STATES, F.col("o_orderstatus")).alias("status"),
        F.col("o_orderdate").alias("start_time"),
        (F.col("o_orderdate") + F.make_dt_interval(hours=(F.col("o_orderkey") % 7 + 1).cast("int"))).alias("end_time"),
        F.col("o_totalprice").alias("input_bytes"),
        (F.col("o_totalprice") * 100).alias("output_bytes"),
        (F.col("o_orderkey") % 9 + 1).alias("compression_ratio"),
    )


def sets(t):
    owner = t.orders.select("o_orderkey", F.col("o_custkey").alias("db_key"))
    return t.lineitem.join(owner, F.col("l_orderkey") == F.col("o_orderkey")).select(
        "db_key",
        F.col("l_orderkey").alias("session_key"),
        (F.col("l_linenumber") % 2).alias("incremental_level"),
        lookup({"R": "D", "A": "I", "N": "L"}, F.col("l_returnflag")).alias("backup_type"),
        F.col("l_quantity").cast("long").alias("pieces"),
        F.when(F.col("l_linestatus") == "O", "YES").otherwise("NO").alias("controlfile_included"),
        F.col("l_shipdate").alias("start_time"),
        F.col("l_shipdate").alias("completion_time"),
        F.col("l_partkey").alias("set_stamp"),
        F.col("l_partkey").alias("set_count"),
    )


def dbs(t):
    return t.customer.select(
        F.col("c_custkey").alias("db_key"), F.col("c_name").alias("name"), (F.col("c_custkey") + 1000).alias("dbid")
    )


def inventory(t):
    alias = F.concat(F.lit("ALIAS"), "c_custkey")
    return t.customer.select(
        F.when(F.col("c_nationkey") == 0, alias).otherwise(F.col("c_name")).alias("database_name"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("server"),
        (F.col("c_custkey") + 1000).alias("dbid"),
    )


def servers(t):
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("server"),
        F.col("r_name").alias("physical_server_abbrev"),
        F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).otherwise(F.col("r_name")).alias("physical_server"),
    )


BASE_SQL = f"""j AS (SELECT o_custkey AS db_key, c_name AS db_name, o_orderkey AS session_key,
      CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'DB FULL' WHEN '2' THEN 'DB INCR' WHEN '3' THEN 'ARCHIVELOG'
        WHEN '4' THEN 'DB FULL' ELSE 'DATAFILE' END AS input_type,
      CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'RUNNING' END AS status,
      o_orderdate AS start_time, o_orderdate + to_hours(CAST(o_orderkey % 7 + 1 AS INT)) AS end_time,
      o_totalprice AS input_bytes, o_totalprice * 100 AS output_bytes, o_orderkey % 9 + 1 AS compression_ratio
      FROM orders JOIN customer ON o_custkey = c_custkey),
    b AS (SELECT o_custkey AS db_key, l_orderkey AS session_key, l_linenumber % 2 AS incremental_level,
      CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'I' WHEN 'N' THEN 'L' END AS backup_type,
      CAST(l_quantity AS BIGINT) AS pieces, CASE WHEN l_linestatus = 'O' THEN 'YES' ELSE 'NO' END AS controlfile_included,
      l_shipdate AS start_time, l_partkey AS set_stamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    x AS (SELECT c_custkey AS db_key, c_name AS name, c_custkey + 1000 AS dbid FROM customer),
    i AS (SELECT CASE WHEN c_nationkey = 0 THEN 'ALIAS' || c_custkey ELSE c_name END AS database_name,
      'NATION_' || c_nationkey AS server, c_custkey + 1000 AS dbid FROM customer),
    s AS (SELECT n_name AS server, r_name AS physical_server_abbrev,
      CASE WHEN n_nationkey % 2 = 0 THEN n_name ELSE r_name END AS physical_server
      FROM nation JOIN region ON n_regionkey = r_regionkey)"""
MARK = "CASE WHEN j.status = 'FAILED' THEN 'FAILED    <---- N.B.' ELSE j.status END"
DETAIL_SQL = f"""SELECT x.dbid, j.db_name, j.input_type, {MARK} AS status, max(j.start_time) AS last_time
      FROM j JOIN x ON j.db_key = x.db_key AND j.db_name = x.name
      WHERE j.start_time > {ORDER_NOW} - INTERVAL 60 DAY AND input_type <> 'DB INCR' GROUP BY ALL
    UNION SELECT x.dbid, j.db_name, CASE WHEN incremental_level = 0 THEN 'DB FULL' ELSE 'DB INCR' END AS k, {MARK}, max(j.start_time)
      FROM j JOIN x ON j.db_key = x.db_key AND j.db_name = x.name JOIN b ON b.session_key = j.session_key AND b.db_key = j.db_key
      WHERE j.start_time > {ORDER_NOW} - INTERVAL 60 DAY AND input_type = 'DB INCR' GROUP BY ALL"""


# The reference window is a week; orders are sparse, so the queries look back 60 days.
@query(
    "b01_backup_details",
    f"WITH {BASE_SQL} {DETAIL_SQL}",
)
def b01(t):
    return bk.backup_details(jobs(t), sets(t), dbs(t), ORDERS_AS_OF, days=60)


MERGED_SQL = f"""SELECT x.dbid, j.db_name, CASE j.input_type WHEN 'DB FULL' THEN 'DATABASE' ELSE j.input_type END AS input_type,
      {MARK} AS status, max(j.start_time) AS last_time FROM j JOIN x ON j.db_key = x.db_key AND j.db_name = x.name
      WHERE j.start_time > {ORDER_NOW} - INTERVAL 61 DAY AND j.input_type <> 'DB INCR' GROUP BY ALL
    UNION SELECT x.dbid, j.db_name, 'DATABASE', {MARK}, max(j.start_time) FROM j JOIN x ON j.db_key = x.db_key AND j.db_name = x.name
      WHERE j.start_time > {ORDER_NOW} - INTERVAL 61 DAY AND j.input_type = 'DB INCR' GROUP BY ALL"""


@query("b01_backup_details_merged", f"WITH {BASE_SQL} {MERGED_SQL}")
def b01_merged(t):
    return bk.backup_details(jobs(t), sets(t), dbs(t), ORDERS_AS_OF, days=61, merged=True)


@query(
    "b02_last_backup",
    f"""WITH {BASE_SQL}, r AS (SELECT DISTINCT x.dbid, j.db_name, {MARK} AS status, j.start_time AS last_time
      FROM j JOIN b ON j.session_key = b.session_key AND j.db_key = b.db_key JOIN x ON j.db_key = x.db_key AND j.db_name = x.name
      WHERE j.start_time > {ORDER_NOW} - INTERVAL 365 DAY AND input_type <> 'ARCHIVELOG'),
    y AS (SELECT *, rank() OVER (PARTITION BY dbid ORDER BY last_time DESC) AS k FROM r)
    SELECT DISTINCT database_name || CASE WHEN db_name = database_name THEN '' ELSE ' (' || db_name || ')' END AS db,
      status, last_time, y.dbid FROM y JOIN i USING (dbid) WHERE k = 1""",
)
def b02(t):
    return bk.last_backup(jobs(t), sets(t), dbs(t), inventory(t), ORDERS_AS_OF)


@query(
    "b03_missing_backups",
    f"""WITH {BASE_SQL}, m AS (SELECT db_key FROM b WHERE backup_type IN ('D', 'I') EXCEPT
      SELECT db_key FROM j WHERE start_time > {ORDER_NOW} - INTERVAL 365 DAY AND input_type LIKE 'DB%' AND status = 'COMPLETED')
    SELECT name AS db_name, dbid FROM m JOIN x USING (db_key)""",
)
def b03(t):
    return bk.missing_backups(sets(t), jobs(t), dbs(t), ORDERS_AS_OF, days=365)


def pieces(t):
    return t.pages.select(
        (F.col("page_id") % 150).alias("db_key"),
        F.col("page_id").alias("bs_key"),
        F.col("url").alias("handle"),
        F.when(F.col("url").startswith("https"), F.lit(None)).otherwise("tape").alias("media"),
        F.when(F.col("url").startswith("https"), "DISK").otherwise("SBT_TAPE").alias("device_type"),
    )


@query(
    "b04_backup_directories",
    f"""WITH {BASE_SQL} SELECT DISTINCT name, regexp_extract(url, '^(.*)/', 1) AS directory
    FROM pages JOIN x ON db_key = page_id % 150 WHERE url LIKE 'https%'""",
)
def b04(t):
    return bk.backup_directories(pieces(t), dbs(t))


LIVE_SQL = f"""f AS (SELECT doc_id % 150 AS db_key, doc_id AS bs_key, source AS file_no, lang,
      CASE WHEN n_chars > 500 THEN 'A' ELSE 'D' END AS status FROM documents),
    live AS (SELECT DISTINCT name, dbid, regexp_extract(url, '^(.*)/', 1) AS directory
      FROM f JOIN pages ON page_id = bs_key AND page_id % 150 = f.db_key JOIN x ON x.db_key = f.db_key
      WHERE status = 'A' AND url LIKE 'https%' AND (lang <> 'fr' OR file_no <> 'src9'))"""


def live_directories(t):
    parts = t.documents.select(
        (F.col("doc_id") % 150).alias("db_key"),
        F.col("doc_id").alias("bs_key"),
        F.col("source").alias("file_no"),
        "lang",
        F.when(F.col("n_chars") > 500, "A").otherwise("D").alias("status"),
    )
    state = parts.select(
        "db_key", "file_no", F.when(F.col("file_no") == "src9", F.lit("dropped")).alias("drop_time")
    ).distinct()
    lang = F.col("lang")
    return bk.live_backup_directories(
        parts.filter(lang == "en"),
        parts.filter(lang == "fr"),
        parts.filter(lang == "de"),
        parts.filter(~lang.isin("en", "fr", "de")),
        state,
        pieces(t),
        dbs(t),
    )


@query("b05_live_backup_directories", f"WITH {BASE_SQL}, {LIVE_SQL} SELECT * FROM live")
def b05(t):
    return live_directories(t)


@query(
    "b06_catalog_summary",
    f"""WITH {BASE_SQL}, r AS ({MERGED_SQL}) SELECT database_name,
      database_name || CASE WHEN db_name = database_name THEN '' ELSE ' (' || db_name || ')' END AS db_name,
      i.server || CASE WHEN physical_server = s.server THEN '' ELSE ' (' || physical_server || ')' END AS server,
      input_type, status, last_time FROM r JOIN i USING (dbid) JOIN s ON s.server = i.server""",
)
def b06(t):
    details = bk.backup_details(jobs(t), sets(t), dbs(t), ORDERS_AS_OF, days=61, merged=True)
    return bk.catalog_summary(details, inventory(t), servers(t))


@query(
    "b06_directories_by_host",
    f"""WITH {BASE_SQL}, {LIVE_SQL} SELECT physical_server_abbrev || ' (' || database_name || ')' AS name,
      'DBID:' || live.dbid AS dbid, directory FROM live JOIN i ON i.dbid = live.dbid JOIN s ON s.server = i.server""",
)
def b06_directories(t):
    return bk.directories_by_host(live_directories(t), inventory(t), servers(t))


@query(
    "b07_backup_verdict",
    f"""WITH {BASE_SQL}, p AS (SELECT c_custkey AS db_key, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 90
        ELSE 200 END AS check_days, CASE WHEN c_nationkey = 3 THEN 'NOARCHIVELOG' ELSE 'ARCHIVELOG' END AS log_mode FROM customer),
    q AS (SELECT p.db_key, check_days, log_mode, j.*, start_time > date_trunc('day', {ORDER_NOW}) - to_days(check_days) AS recent
      FROM p LEFT JOIN j ON j.db_key = p.db_key AND (input_type LIKE 'DB%' OR input_type = 'ARCHIVELOG')),
    g AS (SELECT db_key, check_days, log_mode, count(*) FILTER (WHERE recent AND status = 'COMPLETED') AS n,
      max(start_time) FILTER (WHERE status = 'COMPLETED' AND input_type LIKE 'DB%') AS last_db,
      arg_max(struct_pack(s := status, t := input_type, e := end_time), struct_pack(a := end_time, b := session_key))
        FILTER (WHERE recent AND status <> 'RUNNING') AS card FROM q GROUP BY ALL)
    SELECT db_key, check_days, CASE WHEN check_days = 0 THEN 'DISABLED' WHEN log_mode = 'NOARCHIVELOG' THEN 'NOT APPLICABLE'
      WHEN n < 1 THEN 'ERROR: none recent' WHEN card.s = 'COMPLETED' THEN 'OK' ELSE 'ERROR: last failed' END AS verdict,
      card.s AS last_status, card.t AS last_type, card.e AS last_end, n < 1 AND last_db IS NULL AS no_database_backup FROM g""",
)
def b07(t):
    policy = t.customer.select(
        F.col("c_custkey").alias("db_key"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0).when(F.col("c_mktsegment") == "MACHINERY", 90).otherwise(200).alias("check_days"),
        F.when(F.col("c_nationkey") == 3, "NOARCHIVELOG").otherwise("ARCHIVELOG").alias("log_mode"),
    )
    return bk.backup_verdict(jobs(t), policy, ORDERS_AS_OF)


@query(
    "b08_last_of_each_kind",
    f"""WITH {BASE_SQL}, k AS (SELECT j.db_key, CASE incremental_level WHEN 0 THEN 'full' ELSE 'incremental' END AS kind,
        b.start_time AS o, j.session_key, j.status, j.start_time FROM j JOIN b ON b.session_key = j.session_key AND b.db_key = j.db_key
        WHERE input_type LIKE 'DB%' AND b.start_time > {ORDER_NOW} - INTERVAL 7 DAY
      UNION ALL SELECT db_key, 'log', start_time, session_key, status, start_time FROM j
        WHERE input_type LIKE 'ARC%' AND start_time > {ORDER_NOW} - INTERVAL 7 DAY
      UNION ALL SELECT db_key, 'database failure', start_time, session_key, status, start_time FROM j
        WHERE input_type LIKE 'DB%' AND start_time > {ORDER_NOW} - INTERVAL 32 DAY AND status = 'FAILED'
      UNION ALL SELECT db_key, 'log failure', start_time, session_key, status, start_time FROM j
        WHERE input_type LIKE 'ARC%' AND start_time > {ORDER_NOW} - INTERVAL 32 DAY AND status = 'FAILED')
    SELECT db_key, kind, status, start_time FROM k
    QUALIFY row_number() OVER (PARTITION BY db_key, kind ORDER BY o DESC, session_key DESC) = 1""",
)
def b08(t):
    return bk.last_of_each_kind(jobs(t), sets(t), ORDERS_AS_OF)


@query(
    "b09_last_success_and_last_any",
    f"""WITH {BASE_SQL}, g AS (SELECT db_key, max(start_time) FILTER (WHERE status = 'COMPLETED') AS last_success,
      max(start_time) AS last_start, arg_max(status, struct_pack(a := start_time, b := session_key)) AS last_status
      FROM j WHERE input_type LIKE 'DB%' GROUP BY db_key)
    SELECT x.db_key, name, last_success, last_start, last_status,
      CASE WHEN last_success IS NULL THEN 'No Recent Successful Database Backups Found' END AS success_note,
      CASE WHEN last_start IS NULL THEN 'No Recent Database Backups Found' END AS any_note FROM x LEFT JOIN g USING (db_key)""",
)
def b09(t):
    return bk.last_success_and_last_any(jobs(t), dbs(t))


SECS = "(epoch_us(end_time) - epoch_us(start_time))"


@query(
    "b10_backup_speed",
    f"""WITH {BASE_SQL} SELECT db_name, start_time, end_time, {SECS} // 3600000000 AS hours, {SECS} // 60000000 % 60 AS minutes,
      {SECS} // 1000000 % 60 AS seconds, input_bytes / ({SECS} / 1000000.0::DOUBLE) / 1048576.0::DOUBLE AS mb_per_sec,
      compression_ratio
    FROM j WHERE input_type LIKE 'DB %' AND start_time > {ORDER_NOW} - INTERVAL 32 DAY AND status <> 'FAILED'""",
)
def b10(t):
    return bk.backup_speed(jobs(t), ORDERS_AS_OF)


@query(
    "b11_latest_job_card",
    f"""WITH {BASE_SQL}, c AS (SELECT *, CASE WHEN input_type LIKE 'DB %' THEN 'database' WHEN input_type = 'ARCHIVELOG'
      THEN 'log' END AS job_class FROM j) SELECT db_key, job_class, input_type, status, start_time, end_time, input_bytes,
      input_bytes / ({SECS} / 1000000.0::DOUBLE) / 1048576.0::DOUBLE AS mb_per_sec FROM c WHERE job_class IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY db_key, job_class ORDER BY end_time DESC, session_key DESC) = 1""",
)
def b11(t):
    return bk.latest_job_card(jobs(t))


@query(
    "b12_backup_matrix",
    f"""WITH {BASE_SQL}, d AS (SELECT session_key, pieces, controlfile_included = 'YES' AS control, CASE backup_type WHEN 'L' THEN 'l'
        WHEN 'D' THEN CASE incremental_level WHEN 0 THEN 'i0' END WHEN 'I' THEN CASE incremental_level WHEN 1 THEN 'i1' END END AS class
      FROM b WHERE set_stamp IN (SELECT p_partkey FROM part WHERE p_size <= 45)),
    c AS (SELECT session_key, class, pieces FROM d UNION ALL SELECT session_key, 'cf', pieces FROM d WHERE control),
    n AS (SELECT session_key, class, sum(pieces)::BIGINT AS pieces FROM c GROUP BY ALL),
    o AS (SELECT event_id AS session_key, min(user_id) AS inst_id FROM events GROUP BY ALL),
    m AS (SELECT session_key, map_from_entries(list(ROW(coalesce(class, '-'), pieces))) AS pieces FROM n GROUP BY session_key)
    SELECT j.session_key, start_time, end_time, CAST(round(output_bytes / 1048576) AS BIGINT) AS output_mb, status, input_type,
      {', '.join(f"CASE WHEN pieces IS NOT NULL THEN coalesce(pieces['{k}'], 0) END AS {k}" for k in ('cf', 'i0', 'i1', 'l'))},
      CASE WHEN pieces IS NOT NULL THEN 0::BIGINT END AS df, inst_id
    FROM j LEFT JOIN m ON m.session_key = j.session_key LEFT JOIN o ON o.session_key = j.session_key
    WHERE start_time > {ORDER_NOW} - INTERVAL 90 DAY""",
)
def b12(t):
    scanned = t.part.select(
        F.col("p_partkey").alias("set_stamp"),
        F.col("p_partkey").alias("set_count"),
        F.when(F.col("p_size") > 45, "YES").otherwise("NO").alias("input_file_scan_only"),
    )
    output = t.events.select(F.col("event_id").alias("session_key"), F.col("user_id").alias("inst_id"))
    return bk.backup_matrix(jobs(t), sets(t), scanned, output, ORDERS_AS_OF, days=90)


@query(
    "b13_latest_by_type",
    f"""WITH {BASE_SQL} SELECT db_key, CASE backup_type WHEN 'I' THEN 'Incremental DB' WHEN 'D' THEN 'DB' WHEN 'L' THEN 'Archivelog'
      END AS backup_type, max(start_time) AS latest_backup FROM b GROUP BY ALL""",
)
def b13(t):
    return bk.latest_by_type(sets(t), "db_key")


CONTROL = [
    ("Customer#000000007", 3, "2001-08-01 00:00:00", "2001-08-09 00:00:00", "N", "N"),
    ("Customer#000000007", 9, None, None, "N", "N"),
    ("Customer#000000008", 14, None, None, "N", "N"),
    ("0000012", 5, None, None, "Y", "Y"),
    ("99", 7, None, None, "Y", "N"),
    ("Customer#00000000", 4, None, None, "N", "Y"),
]
CONTROL_COLS = "database_name, check_days, blackout_from, blackout_to, fuzzy_char_before, fuzzy_char_after"


@query(
    "b14_backup_age_policy",
    f"""WITH k AS (SELECT * FROM (VALUES {sql_values(CONTROL)}) v({CONTROL_COLS})),
    m AS (SELECT c_name, 1 AS r, 0 AS days FROM customer JOIN k ON database_name = c_name
        WHERE CAST(blackout_from AS TIMESTAMP) <= {ORDER_NOW} AND CAST(blackout_to AS TIMESTAMP) >= {ORDER_NOW}
      UNION ALL SELECT c_name, 2, check_days FROM customer JOIN k ON database_name = c_name
        WHERE blackout_from IS NULL AND fuzzy_char_before = 'N' AND fuzzy_char_after = 'N'
      UNION ALL SELECT c_name, 3, check_days FROM customer JOIN k ON c_name LIKE CASE fuzzy_char_before WHEN 'Y' THEN '%' ELSE '' END
        || database_name || CASE fuzzy_char_after WHEN 'Y' THEN '%' ELSE '' END
        WHERE blackout_from IS NULL AND (fuzzy_char_before = 'Y' OR fuzzy_char_after = 'Y'))
    SELECT c.c_name AS database_name, coalesce((SELECT days FROM m WHERE m.c_name = c.c_name ORDER BY r, days LIMIT 1), 1) AS check_days
    FROM customer c""",
)
def b14(t):
    control = t.rows(
        CONTROL,
        "database_name string, check_days int, blackout_from string, blackout_to string, "
        "fuzzy_char_before string, fuzzy_char_after string",
    )
    for c in ("blackout_from", "blackout_to"):
        control = control.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return bk.backup_age_policy(t.customer.select(F.col("c_name").alias("database_name")), control, ORDERS_AS_OF)


@query("b15_catalog_names", "SELECT DISTINCT c_name AS name FROM customer")
def b15(t):
    return bk.catalog_names(dbs(t))
