"""Capacity queries over the driver tables."""

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import cat
from fleetlens.operators import capacity as cap
from fleetlens.operators import latest
from fleetlens.plans.registry import AS_OF, EVENT_NOW, ORDER_NOW, ORDERS_AS_OF, Tables, query, sql_values

ENTITY = ["user_id", "event_type"]
TODAY = "TIMESTAMP '2024-01-30'"


def usage_history(t: Tables) -> DataFrame:
    return t.events.select("event_id", *ENTITY, "ts", (F.col("value") % 100).alias("pctused"), "value")


def _band_sql(name: str, test: str) -> str:
    return f"""{name} AS (SELECT user_id, event_type, value % 100 AS pct, value FROM events WHERE {test}
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1)"""


def band_sql(how: str = "JOIN") -> str:
    """The four bands as four separate scans and three joins, the form the operator avoids."""
    ctes = ",\n    ".join(
        [
            _band_sql("n", f"ts >= {TODAY}"),
            _band_sql("y", f"ts < {TODAY} AND ts >= {TODAY} - INTERVAL 7 DAY"),
            _band_sql("l", f"ts <= {TODAY} - INTERVAL 7 DAY AND ts >= {TODAY} - INTERVAL 13 DAY"),
            _band_sql("m", f"ts <= {TODAY} - INTERVAL 13 DAY AND ts >= {TODAY} - INTERVAL 62 DAY"),
        ]
    )
    return f"""WITH {ctes},
    b AS (SELECT n.user_id, n.event_type, n.value AS value, n.pct AS now_pct,
      y.pct AS yesterday_raw, l.pct AS lastweek_raw, m.pct AS lastmonth_raw,
      coalesce(y.pct, 0) AS yesterday_pct, coalesce(l.pct, y.pct, 0) AS lastweek_pct,
      coalesce(m.pct, l.pct, y.pct, 0) AS lastmonth_pct,
      n.pct - coalesce(y.pct, 0) AS day_growth, n.pct - coalesce(l.pct, y.pct, 0) AS week_growth,
      n.pct - coalesce(m.pct, l.pct, y.pct, 0) AS month_growth,
      y.pct IS NULL AS no_yesterday, l.pct IS NULL AS no_lastweek, m.pct IS NULL AS no_lastmonth
      FROM n {how} y USING (user_id, event_type) {how} l USING (user_id, event_type)
             {how} m USING (user_id, event_type))"""


def ladder_sql(day, week, err, crit, brown="", red="", amber=""):
    return f"""CASE WHEN now_pct > {crit} AND now_pct > lastweek_raw THEN 'Error: Weekly growth{brown}'
      WHEN now_pct > {err} AND now_pct > lastweek_raw + 2 THEN 'Error: Weekly growth{red}'
      WHEN now_pct > {week} AND 100 - now_pct < now_pct - lastweek_raw THEN 'Error: Weekly growth{amber}'
      WHEN now_pct > {day} AND 100 - now_pct < now_pct - yesterday_raw THEN 'Error: Daily growth{amber}'
      ELSE 'OK' END AS status"""


@query(
    "c01_latest_in_band",
    f"""SELECT event_id, user_id, event_type, ts, value % 100 AS pctused FROM events
    WHERE ts < {TODAY} AND ts >= {TODAY} - INTERVAL 7 DAY
    QUALIFY rank() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC) = 1""",
)
def c01(t):
    band = cap.capacity_bands(AS_OF)[1]
    return latest.latest_in_band(usage_history(t).drop("value"), ENTITY, "ts", band)


def compare(t, how="inner"):
    # History is keyed by entity and time, so the latest row of a band is unique without a tie-break.
    return cap.band_compare(usage_history(t), ENTITY, "ts", "pctused", AS_OF, how=how, extra=["value"])


@query("c02_band_compare", band_sql() + " SELECT * FROM b")
def c02(t):
    return compare(t)


@query("c03a_growth_status", f"{band_sql()} SELECT *, {ladder_sql(80, 50, 95, 98)} FROM b")
def c03a(t):
    return cap.growth_status(compare(t))


@query(
    "c03b_growth_status_tiered",
    f"""{band_sql()} SELECT *, {ladder_sql(86, 54, 93, 97, ' (Brown)', ' (Red)', ' (Amber)')} FROM b""",
)
def c03b(t):
    return cap.growth_status(compare(t), t_day=90, weighting=4, tiered=True)


LIMITS = [("click", 70.0, None, None, None), ("view", 99.0, 99.0, 99.0, 150.0), ("error", None, 30.0, 20.0, 40.0)]
LIMIT_COLS = "event_type, error_pct_day, error_pct_week, error_pct_month, error_size_in_k"


@query(
    "c03c_growth_status_overrides",
    f"""{band_sql('LEFT JOIN')}, t AS (SELECT * FROM (VALUES {sql_values(LIMITS)}) v({LIMIT_COLS}))
    SELECT b.*, error_pct_day, error_pct_week, error_pct_month, error_size_in_k,
      CASE WHEN now_pct > yesterday_raw AND (now_pct > coalesce(error_pct_day, 80)
             OR (now_pct - yesterday_raw) * 4 >= 100 - now_pct) THEN '*ERROR (day)*'
           WHEN now_pct > lastweek_raw AND now_pct > yesterday_raw AND (now_pct > coalesce(error_pct_week, 60)
             OR (now_pct - lastweek_raw) * 2 >= 100 - now_pct) THEN '*ERROR (wk)*'
           WHEN now_pct > lastmonth_raw AND now_pct > yesterday_raw AND (now_pct > coalesce(error_pct_month, 50)
             OR now_pct - lastmonth_raw >= 100 - now_pct) THEN '*ERROR (mth)*'
           WHEN value > error_size_in_k THEN '*ERROR (size)*' ELSE ' ' END AS status
    FROM b LEFT JOIN t USING (event_type)""",
)
def c03c(t):
    limits = t.rows(
        LIMITS,
        "event_type string, error_pct_day double, error_pct_week double, error_pct_month double, error_size_in_k double",
    )
    return cap.growth_status_overrides(compare(t, "left"), limits, "event_type", used="value")


@query("c04_capacity_summary", f"{band_sql('LEFT JOIN')} SELECT * EXCLUDE (value), {ladder_sql(90, 50, 95, 98)} FROM b")
def c04(t):
    rows = cap.band_compare(usage_history(t), ENTITY, "ts", "pctused", AS_OF, how="left")
    return cap.growth_status(rows, t_day=90)


def fleet(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers as databases, nations as servers, regions as physical hosts and clusters."""
    databases = t.customer.select(
        F.col("c_custkey").alias("database_id"),
        F.col("c_name").alias("database_name"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("server"),
        F.when(F.col("c_acctbal") < 0, "Y").otherwise("N").alias("disabled"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Y").otherwise("N").alias("production_ind"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "Y").otherwise("N").alias("os_checks_ind"),
        (F.col("c_custkey") % 100).alias("dbid"),
    )
    servers = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("server"),
        F.concat("r_name", F.lit("."), "n_name", F.lit(".example")).alias("physical_server"),
        F.col("r_name").alias("physical_server_abbrev"),
        F.when(F.col("n_nationkey") % 6 == 0, F.lit(None)).otherwise(F.col("r_name")).alias("cluster_name"),
        F.when(F.col("n_nationkey") == 7, "Y").otherwise("N").alias("disabled"),
        F.when(F.col("n_nationkey") == 8, "Y").otherwise("N").alias("ping_disabled"),
    )
    return databases, servers


FLEET_SQL = """d AS (SELECT c_custkey AS database_id, c_name AS database_name, 'NATION_' || c_nationkey AS server,
      CASE WHEN c_acctbal < 0 THEN 'Y' ELSE 'N' END AS disabled,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'Y' ELSE 'N' END AS production_ind,
      CASE WHEN c_mktsegment = 'MACHINERY' THEN 'Y' ELSE 'N' END AS os_checks_ind,
      c_custkey % 100 AS dbid FROM customer),
    s AS (SELECT n_name AS server, r_name || '.' || n_name || '.example' AS physical_server,
      r_name AS physical_server_abbrev, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE r_name END AS cluster_name,
      CASE WHEN n_nationkey = 7 THEN 'Y' ELSE 'N' END AS disabled,
      CASE WHEN n_nationkey = 8 THEN 'Y' ELSE 'N' END AS ping_disabled
      FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "c05_expand_to_peers",
    f"""WITH {FLEET_SQL} SELECT DISTINCT s2.physical_server_abbrev AS host, d2.database_name
    FROM d d1 JOIN s s1 ON d1.server = s1.server
    JOIN s s2 ON s1.physical_server_abbrev = s2.physical_server_abbrev
    JOIN d d2 ON d2.server = s2.server
    WHERE d2.os_checks_ind = 'Y' AND d1.disabled <> 'Y' AND d2.disabled <> 'Y'""",
)
def c05(t):
    return cap.expand_to_peers(*fleet(t))


@query(
    "c06_recent_history",
    f"""{band_sql()}, f AS (SELECT *, {ladder_sql(80, 50, 95, 98)} FROM b)
    SELECT event_id, e.user_id, e.event_type, ts, e.value % 100 AS pctused FROM events e
    WHERE ts > {TODAY} - INTERVAL 14 DAY AND EXISTS (SELECT 1 FROM f
      WHERE f.user_id = e.user_id AND f.event_type = e.event_type AND status LIKE 'Error%')""",
)
def c06(t):
    alerting = cap.growth_status(compare(t)).filter(F.col("status").startswith("Error"))
    return cap.recent_history(usage_history(t).drop("value"), alerting, ENTITY, "ts", AS_OF)


@query(
    "c07_daily_high_water",
    """SELECT user_id, event_type, CAST(ts AS DATE) AS day, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)
      ORDER BY value DESC, ts, event_id DESC) = 1""",
)
def c07(t):
    history = t.events.select("event_id", *ENTITY, "ts", "value")
    return cap.daily_high_water(history, ENTITY, "ts", "value", tie_break=["event_id"])


def _horizon_sql(name: str, days: int) -> str:
    return f"""{name} AS (SELECT o_custkey, o_totalprice AS used FROM orders
      WHERE o_orderdate > {ORDER_NOW} - INTERVAL {days} DAY
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)"""


def _growth_sql(alias: str, name: str) -> str:
    return f"""{alias}.used AS {name}_used,
      CASE WHEN {alias}.used <> 0 THEN n.used - {alias}.used END AS {name}_growth,
      CASE WHEN {alias}.used <> 0 THEN (n.used - {alias}.used) / {alias}.used * 100 END AS {name}_growth_pct"""


@query(
    "c08_growth_report",
    f"""WITH n AS (SELECT o_custkey, o_orderdate, o_totalprice AS used FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    {_horizon_sql('m', 31)}, {_horizon_sql('s', 183)}, {_horizon_sql('y', 365)}
    SELECT n.o_custkey, n.o_orderdate AS date_now, n.used AS now_used, {_growth_sql('m', 'month')},
      {_growth_sql('s', 'six_month')}, {_growth_sql('y', 'year')}
    FROM n JOIN m USING (o_custkey) JOIN s USING (o_custkey) JOIN y USING (o_custkey)""",
)
def c08(t):
    return cap.growth_report(
        t.orders, "o_custkey", "o_orderdate", "o_totalprice", ORDERS_AS_OF, tie_break=["o_orderkey"]
    )


@query(
    "c09_month_end_series",
    f"""SELECT o_custkey, strftime(o_orderdate, '%y%m') AS month_no, CAST(o_orderdate AS DATE) AS space_date,
      coalesce(o_totalprice, 0) AS o_totalprice FROM orders WHERE o_orderdate > {ORDER_NOW} - INTERVAL 365 DAY
    QUALIFY rank() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%y%m')
      ORDER BY CAST(o_orderdate AS DATE) DESC) = 1""",
)
def c09(t):
    return latest.month_end_series(t.orders, "o_custkey", "o_orderdate", "o_totalprice", ORDERS_AS_OF)


def containers(t: Tables):
    """Lineitems as data files, orders as temporary files, suppliers and priorities as containers."""
    owner = t.supplier.select("s_suppkey", F.concat(F.lit("DB"), "s_nationkey").alias("database_name"))
    lines = t.lineitem.join(owner, F.col("l_suppkey") == F.col("s_suppkey"))
    name = F.concat(F.lit("TS"), "l_suppkey")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    data = lines.select(
        "database_name",
        name.alias("container"),
        cents.alias("bytes"),
        (F.col("l_quantity").cast("long") * 300000).alias("maxbytes"),
    )
    free = lines.select(
        "database_name",
        name.alias("container"),
        F.round(F.col("l_discount") * F.col("l_extendedprice") * 1000).cast("long").alias("bytes"),
    )
    home = t.customer.select("c_custkey", F.concat(F.lit("DB"), "c_nationkey").alias("database_name"))
    temp = t.orders.join(home, F.col("o_custkey") == F.col("c_custkey")).select(
        "database_name",
        F.concat(F.lit("TEMP"), F.substring("o_orderpriority", 1, 1)).alias("container"),
        F.round(F.col("o_totalprice")).cast("long").alias("bytes"),
        F.lit(None).cast("long").alias("maxbytes"),
    )
    kinds = owner.select(
        "database_name",
        F.concat(F.lit("TS"), "s_suppkey").alias("container"),
        F.when(F.col("s_suppkey") % 5 == 0, "UNDO").otherwise("PERMANENT").alias("contents"),
    ).unionByName(
        temp.select("database_name", "container").distinct().withColumn("contents", F.lit("TEMPORARY"))
    )
    return data, temp, free, kinds


CONTAINER_SQL = """data AS (SELECT 'DB' || s_nationkey AS database_name, 'TS' || l_suppkey AS container,
      CAST(round(l_extendedprice * 100) AS BIGINT) AS bytes, CAST(l_quantity AS BIGINT) * 300000 AS maxbytes,
      CAST(round(l_discount * l_extendedprice * 1000) AS BIGINT) AS room
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
    temp AS (SELECT 'DB' || c_nationkey AS database_name, 'TEMP' || substr(o_orderpriority, 1, 1) AS container,
      CAST(round(o_totalprice) AS BIGINT) AS bytes FROM orders JOIN customer ON o_custkey = c_custkey),
    alloc AS (SELECT database_name, container, CAST(sum(bytes) AS DOUBLE) / 1048576.0 AS total_mb,
        CAST(sum(greatest(maxbytes, bytes)) AS DOUBLE) / 1048576.0 AS max_known FROM data GROUP BY ALL
      UNION ALL SELECT database_name, container, CAST(sum(bytes) AS DOUBLE) / 1048576.0, NULL FROM temp GROUP BY ALL),
    room AS (SELECT database_name, container, CAST(sum(room) AS DOUBLE) / 1048576.0 AS free_mb FROM data GROUP BY ALL),
    kinds AS (SELECT 'DB' || s_nationkey AS database_name, 'TS' || s_suppkey AS container,
        CASE WHEN s_suppkey % 5 = 0 THEN ' (u) ' ELSE '' END AS kind FROM supplier
      UNION ALL SELECT DISTINCT database_name, container, ' (t) ' FROM temp),
    base AS (SELECT a.database_name, a.container, kind, total_mb, total_mb - coalesce(free_mb, 0) AS used_mb,
        coalesce(free_mb, 0) AS free_mb, coalesce(max_known, total_mb) AS max_mb
      FROM alloc a LEFT JOIN room USING (database_name, container) LEFT JOIN kinds USING (database_name, container)),
    usage AS (SELECT *, used_mb / total_mb * 100 AS pct_used, used_mb / max_mb * 100 AS pct_max_used FROM base)"""


def _bar_sql(c: str) -> str:
    return f"'[' || rpad(repeat('X', CAST(floor(round({c}, 2) / 5) AS INT)), 20, '-') || ']'"


def usage(t, **kw):
    data, temp, free, kinds = containers(t)
    return cap.container_usage([data, temp], free, kinds, ["database_name", "container"], **kw)


@query(
    "c10_container_usage",
    f"""WITH {CONTAINER_SQL} SELECT *, {_bar_sql('pct_used')} AS bar, {_bar_sql('pct_max_used')} AS max_bar
    FROM usage WHERE pct_used > 40""",
)
def c10(t):
    return usage(t, min_pct=40)


@query(
    "c10_container_totals",
    f"""WITH {CONTAINER_SQL} SELECT round(sum(total_mb), 4) AS grand_total_mb, round(sum(used_mb), 4) AS grand_used_mb,
      round(sum(free_mb), 4) AS grand_free_mb FROM usage""",
)
def c10_totals(t):
    totals = cap.container_totals(usage(t))
    return totals.select(*[F.round(c, 4).alias(c) for c in totals.columns])


@query(
    "c11_container_alerts",
    f"""WITH {CONTAINER_SQL}, o AS (SELECT database_name, container || '(' || CAST(round(pct_max_used) AS BIGINT) || '%)' AS item
      FROM usage WHERE kind = '' AND round(pct_max_used) > 26)
    SELECT database_name, item, '** ERROR - tablespace alerts on ' || database_name || ': ' || item || ' **' AS message FROM o
    UNION ALL SELECT database_name, NULL, '** No tablespace alerts for ' || database_name || ' **'
    FROM (SELECT database_name FROM usage EXCEPT SELECT database_name FROM o)""",
)
def c11(t):
    return cap.container_alerts(usage(t), "database_name", "container", pct=26)


@query(
    "c12_container_snapshot",
    f"""WITH {CONTAINER_SQL} SELECT 'driver' AS server,
      container || CASE kind WHEN ' (u) ' THEN '(U)' WHEN ' (t) ' THEN '(T)' ELSE '' END AS container,
      {EVENT_NOW} AS space_time, total_mb AS meg_data, used_mb AS meg_used, free_mb AS meg_free
    FROM usage""",
)
def c12(t):
    return cap.container_snapshot(usage(t), "container", datetime.fromisoformat(AS_OF), server="driver")


@query(
    "c13_total_size_snapshot",
    f"""WITH {CONTAINER_SQL}, g AS (SELECT database_name, sum(bytes) AS d, sum(room) AS f, 0 AS t FROM data GROUP BY ALL
      UNION ALL SELECT database_name, 0, 0, sum(bytes) FROM temp GROUP BY ALL)
    SELECT database_name, CAST(sum(d) AS DOUBLE) / 1073741824.0 AS gig_data,
      CAST(sum(t) AS DOUBLE) / 1073741824.0 AS gig_temp, CAST(sum(f) AS DOUBLE) / 1073741824.0 AS gig_free,
      CAST(sum(d) AS DOUBLE) / 1073741824.0 - CAST(sum(f) AS DOUBLE) / 1073741824.0 AS gig_used
    FROM g GROUP BY database_name""",
)
def c13(t):
    data, temp, free, _ = containers(t)
    return cap.total_size_snapshot(data, temp, free, "database_name")


@query(
    "c14_latest_per_key",
    """SELECT user_id, event_id, ts, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
)
def c14(t):
    rows = t.events.select("user_id", "event_id", "ts", "event_type", "value")
    return latest.latest_per_key(rows, "user_id", "ts", ["event_id"])


def file_list(t: Tables) -> DataFrame:
    """Pages as data files, documents as temporary files, conversations as log groups, suppliers as control files.

    Each of three databases has them; group numbers repeat, sizes of groups differ.
    """

    def in_each(df):
        n = F.explode(F.array(*[F.lit(i) for i in range(3)]))
        return df.withColumn("n", n).withColumn("database", F.concat(F.lit("DB"), "n"))

    data = in_each(t.pages).select("database", F.col("url").alias("file_name"), F.length("html").cast("long").alias("bytes"))
    temp = in_each(t.documents).select(
        "database",
        F.concat(F.lit("/temp/"), "lang", F.lit("/"), "source", F.lit("/"), "doc_id").alias("file_name"),
        F.col("n_chars").alias("bytes"),
    )
    members = in_each(t.conversations).select(
        "database",
        F.col("conv_id").alias("group_no"), F.concat(F.lit("/log/"), "role", F.lit("/"), "turn").alias("member")
    )
    groups = t.conversations.groupBy(F.col("conv_id").alias("group_no")).agg(F.sum(F.length("text")).alias("chars"))
    groups = in_each(groups).select("database", "group_no", (F.col("chars") * (F.col("n") + 1)).alias("bytes"))
    control = in_each(t.supplier).select(
        "database",
        F.concat(F.lit("/ctl/"), "s_nationkey", F.lit("/"), "s_suppkey").alias("file_name"),
        F.lit(16384).cast("long").alias("block_size"),
        (F.col("s_suppkey") + 1).alias("file_size_blocks"),
    )
    return cap.all_files(data, temp, members, groups, control, "database")


FILES_SQL = """one AS (SELECT url AS file_name, length(html) AS bytes, 0 AS per FROM pages
      UNION ALL SELECT '/temp/' || lang || '/' || source || '/' || doc_id, n_chars, 0 FROM documents
      UNION ALL SELECT '/log/' || role || '/' || turn, g.chars, 1 FROM conversations c
        JOIN (SELECT conv_id, sum(length(text)) AS chars FROM conversations GROUP BY ALL) g ON g.conv_id = c.conv_id
      UNION ALL SELECT '/ctl/' || s_nationkey || '/' || s_suppkey, 16384 * (s_suppkey + 1), 0 FROM supplier),
    files AS (SELECT 'DB' || n AS database, file_name, bytes * (1 + per * n) AS bytes FROM one, range(3) r(n))"""


@query(
    "c15_size_by_directory",
    f"""WITH {FILES_SQL} SELECT database, regexp_extract(file_name, '^(.*)/', 1) AS directory,
      CAST(sum(bytes) AS DOUBLE) / 1048576.0 AS meg FROM files GROUP BY ALL""",
)
def c15(t):
    return cap.size_by_directory(file_list(t), "database")


@query("c15_total_size", f"WITH {FILES_SQL} SELECT database, CAST(sum(bytes) AS DOUBLE) / 1048576.0 AS meg FROM files GROUP BY database")
def c15_total(t):
    return cap.total_size(file_list(t), "database")


@query(
    "c15_size_by_prefix",
    f"""WITH {FILES_SQL} SELECT database, substr(file_name, 1, 4) AS mountpoint, CAST(sum(bytes) AS BIGINT) AS mount_size
    FROM files GROUP BY ALL""",
)
def c15_prefix(t):
    return cap.size_by_prefix(file_list(t), 4, "database")


@query(
    "c16_size_by_kind",
    """SELECT s_suppkey AS database_id, CAST(r AS DOUBLE) * 8 / 1024 AS row_size_mb,
      CAST(l AS DOUBLE) * 8 / 1024 AS log_size_mb FROM supplier LEFT JOIN (SELECT l_suppkey,
        sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'F') AS r,
        sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_linestatus = 'O') AS l
      FROM lineitem GROUP BY l_suppkey) ON l_suppkey = s_suppkey""",
)
def c16(t):
    files = t.lineitem.select(
        F.col("l_suppkey").alias("database_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("type"),
        F.col("l_quantity").cast("long").alias("size"),
    )
    return cap.size_by_kind(t.supplier.select(F.col("s_suppkey").alias("database_id")), files)


PARAMS = [
    ("NATION_1", None, None, 70.0),
    ("NATION_2", None, None, 75.0),
    ("BUILDING", "NATION_1", None, 60.0),
    ("MACHINERY", "NATION_19", None, 65.0),
    ("Customer#000000001", "MACHINERY", "NATION_19", 50.0),
]


@query(
    "c17_resolve_threshold",
    f"""WITH p AS (SELECT * FROM (VALUES {sql_values(PARAMS)}) v(n, par, gp, val)),
    e AS (SELECT c_name AS container, c_mktsegment AS database_name, 'NATION_' || c_nationkey AS server FROM customer)
    SELECT e.*, coalesce(
      (SELECT max(val) FROM p WHERE n = container AND par = database_name AND gp = server),
      (SELECT max(val) FROM p WHERE n = database_name AND par = server AND gp IS NULL),
      (SELECT max(val) FROM p WHERE n = server AND par IS NULL AND gp IS NULL), 95.0::DOUBLE) AS threshold FROM e""",
)
def c17(t):
    params = t.rows(PARAMS, "param_name string, param_parent string, param_grand_parent string, param_value_num double")
    entities = t.customer.select(
        F.col("c_name").alias("container"),
        F.col("c_mktsegment").alias("database_name"),
        F.concat(F.lit("NATION_"), "c_nationkey").alias("server"),
    )
    return cap.resolve_threshold(entities, params)


@query(
    "c18_staleness",
    f"""WITH n AS (SELECT user_id, event_type, max(ts) AS newest FROM events GROUP BY ALL),
    a AS (SELECT *, CAST(round((epoch_us({EVENT_NOW}) - epoch_us(newest)) / 86400000000.0) AS BIGINT) AS days_old FROM n)
    SELECT *, CASE WHEN days_old > 3 THEN 'WARNING' ELSE 'OK' END AS status FROM a""",
)
def c18(t):
    return cap.staleness(t.events, "ts", AS_OF, ENTITY, max_age_days=3)


@query(
    "c19_group_members",
    """WITH g AS (SELECT p_size AS group_no, sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS bytes FROM part GROUP BY ALL)
    SELECT group_no, '''' || p_name || ' ' || p_partkey || '''' AS member, CAST(bytes AS DOUBLE) / 1048576.0 AS size_mb
    FROM g JOIN part ON p_size = group_no WHERE group_no <> (SELECT max(group_no) FROM g)""",
)
def c19(t):
    groups = t.part.groupBy(F.col("p_size").alias("group_no")).agg(
        F.sum(F.round(F.col("p_retailprice") * 100).cast("long")).alias("bytes")
    )
    members = t.part.select(
        F.col("p_size").alias("group_no"), cat(F.col("p_name"), " ", F.col("p_partkey").cast("string")).alias("member")
    )
    return cap.group_members(groups, members)
