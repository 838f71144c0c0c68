"""Account, job and instance health queries: customers as accounts, orders as jobs and objects."""

from pyspark.sql import functions as F

from fleetlens.functions.semantics import version_number
from fleetlens.operators import health as hl
from fleetlens.plans.registry import ORDER_NOW, ORDERS_AS_OF, query


DB = "database"


def database(number):
    return F.concat(F.lit("DB"), F.col(number) % 3).alias(DB)


def users(t):
    segment = F.col("c_mktsegment")
    status = (
        F.when(segment == "MACHINERY", "EXPIRED")
        .when(segment == "FURNITURE", "EXPIRED(GRACE)")
        .when(segment == "HOUSEHOLD", "LOCKED")
        .otherwise("OPEN")
    )
    now = F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    return t.customer.select(
        database("c_custkey"),
        F.col("c_name").alias("username"),
        status.alias("account_status"),
        F.when(
            F.col("c_nationkey") != 0, now + F.make_dt_interval(days=(F.col("c_custkey") % 120 - 60).cast("int"))
        ).alias("expiry_date"),
        F.concat(F.lit("P"), "c_nationkey").alias("profile"),
    )


USERS_SQL = f"""u AS (SELECT 'DB' || c_custkey % 3 AS database, c_name AS username, CASE c_mktsegment WHEN 'MACHINERY' THEN 'EXPIRED' WHEN 'FURNITURE' THEN 'EXPIRED(GRACE)'
      WHEN 'HOUSEHOLD' THEN 'LOCKED' ELSE 'OPEN' END AS account_status,
      CASE WHEN c_nationkey <> 0 THEN {ORDER_NOW} + to_days(CAST(c_custkey % 120 - 60 AS INT)) END AS expiry_date,
      'P' || c_nationkey AS profile FROM customer)"""
EXPIRY_SQL = f"""e AS (SELECT database, username, expiry_date, profile, account_status,
      CASE WHEN expiry_date < {ORDER_NOW} THEN 'expired' ELSE 'expires' END AS tense FROM u
      WHERE (account_status = 'OPEN' AND expiry_date IS NOT NULL AND expiry_date < {ORDER_NOW} + INTERVAL 31 DAY)
        OR account_status = 'EXPIRED' OR account_status = 'EXPIRED(GRACE)')"""


@query("h01_password_expiry", f"WITH {USERS_SQL}, {EXPIRY_SQL} SELECT * FROM e")
def h01(t):
    return hl.password_expiry(users(t), ORDERS_AS_OF, by=DB)


@query(
    "h01_password_expiry_message",
    f"""WITH {USERS_SQL}, {EXPIRY_SQL} SELECT database, profile, '** WARNING - ' || count(*) || CASE WHEN count(*) = 1 THEN ' user' ELSE ' users' END
      || ' found with Password Expiry Issues **' AS message FROM e GROUP BY database, profile""",
)
def h01_message(t):
    return hl.password_expiry_message(hl.password_expiry(users(t), ORDERS_AS_OF, by=DB), [DB, "profile"])


@query(
    "h02_stale_passwords",
    f"""WITH a AS (SELECT c_name AS name, max(o_orderdate) AS ptime FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
    SELECT name, ptime, CAST(round((epoch_us({ORDER_NOW}) - epoch_us(ptime)) / 86400000000.0) AS BIGINT) AS days_ago FROM a
    WHERE ptime < {ORDER_NOW} - INTERVAL 365 DAY AND name NOT LIKE 'APEX%' AND name <> 'Customer#000000001'
      AND name NOT IN (SELECT 'Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') FROM supplier)""",
)
def h02(t):
    accounts = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.col("c_name").alias("name"))
        .agg(F.max("o_orderdate").alias("ptime"))
    )
    shipped = t.supplier.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("user_name")
    )
    return hl.stale_passwords(accounts, shipped, ORDERS_AS_OF, exclude=["Customer#000000001"])


@query(
    "h03_default_password_users",
    f"""WITH {USERS_SQL} SELECT username, account_status FROM u WHERE account_status NOT IN ('LOCKED', 'EXPIRED & LOCKED')
      AND username IN (SELECT 'Customer#' || lpad(CAST(user_id AS VARCHAR), 9, '0') FROM events)""",
)
def h03(t):
    shipped = t.events.select(
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("username")
    )
    return hl.default_password_users(shipped, users(t))


SERVICE = ["OPEN", "EXPIRED"]


@query(
    "h04_service_account_expiry",
    f"""WITH {USERS_SQL}, s AS (SELECT database, account_status AS username, expiry_date FROM u WHERE account_status IN ('OPEN', 'EXPIRED'))
    SELECT database, username, 'WARNING: The password for ' || username || ' expires on ' || strftime(expiry_date, '%d-%b-%y') AS expiry_info
      FROM s WHERE coalesce(expiry_date, {ORDER_NOW} + INTERVAL 365 DAY) < {ORDER_NOW} + INTERVAL 31 DAY
    UNION ALL SELECT database, username, 'The password for ' || username || ' expires on '
      || coalesce(strftime(expiry_date, '%d-%b-%y'), '** No Expiry Date Set **')
      FROM s WHERE coalesce(expiry_date, {ORDER_NOW} + INTERVAL 365 DAY) >= {ORDER_NOW} + INTERVAL 31 DAY""",
)
def h04(t):
    accounts = users(t).select(DB, F.col("account_status").alias("username"), "expiry_date")
    return hl.service_account_expiry(accounts, SERVICE, ORDERS_AS_OF, by=DB)


def batch_jobs(t):
    return t.orders.select(
        database("o_custkey"),
        F.col("o_orderkey").alias("job"),
        F.col("o_custkey").alias("log_user"),
        F.col("o_orderdate").alias("last_date"),
        F.when(F.col("o_orderstatus") == "P", "Y").otherwise("N").alias("broken"),
        (F.col("o_orderkey") % 4).alias("failures"),
        F.col("o_orderpriority").alias("what"),
    )


JOBS_SQL = """j AS (SELECT 'DB' || o_custkey % 3 AS database, o_orderkey AS job, o_custkey AS log_user, o_orderdate AS last_date,
      CASE WHEN o_orderstatus = 'P' THEN 'Y' ELSE 'N' END AS broken, o_orderkey % 4 AS failures, o_orderpriority AS what FROM orders)"""


@query(
    "h05_broken_jobs_brief",
    f"WITH {JOBS_SQL} SELECT * REPLACE ('Broken.' AS broken) FROM j WHERE broken = 'Y' AND failures > 0",
)
def h05(t):
    """The caller's short list: jobs that are both broken and failed."""
    return hl.broken_jobs(batch_jobs(t), DB).filter("broken = 'Broken.' AND failures > 0")


@query(
    "h05_broken_jobs_full",
    f"""WITH {JOBS_SQL} SELECT * REPLACE (CASE broken WHEN 'Y' THEN 'Broken.' ELSE 'Not Broken.' END AS broken) FROM j
    WHERE broken = 'Y' OR failures > 0""",
)
def h05_full(t):
    return hl.broken_jobs(batch_jobs(t), DB)


@query(
    "h05_broken_jobs_message",
    f"""WITH {JOBS_SQL}, c AS (SELECT database, log_user, count(*) FILTER (WHERE broken = 'Y' OR failures > 0) AS n FROM j GROUP BY ALL)
    SELECT database, log_user, CASE WHEN n < 1 THEN '** No Unsuccessful or Broken Jobs Found **'
      ELSE '** WARNING - ' || n || ' failed or broken ' || CASE WHEN n = 1 THEN 'job' ELSE 'jobs' END || ' found **' END AS message FROM c""",
)
def h05_message(t):
    return hl.broken_jobs_message(batch_jobs(t), by=[DB, "log_user"])


@query(
    "h06_locked_stats",
    """SELECT p_type AS kind, count(*) FILTER (WHERE p_size > 25 AND p_brand NOT LIKE '%2%') AS locked_tables,
      CASE WHEN count(*) FILTER (WHERE p_size > 25 AND p_brand NOT LIKE '%2%') > 0 THEN 'WARNING' ELSE 'OK' END AS status
    FROM part GROUP BY p_type""",
)
def h06(t):
    tables = t.part.select(
        F.col("p_type").alias("kind"),
        F.regexp_replace("p_brand", "2", "SYS").alias("owner"),
        F.when(F.col("p_size") > 25, "ALL").alias("stattype_locked"),
    )
    return hl.locked_stats(tables, "kind")


@query(
    "h07_recent_objects",
    f"""SELECT o_custkey || '.' || 'OBJ' || o_orderkey || ' (' || o_orderpriority || ')' AS object, o_orderdate AS created FROM orders
    WHERE o_orderdate > TIMESTAMP '2001-06-01' + INTERVAL 1 DAY AND o_orderdate > {ORDER_NOW} - INTERVAL 90 DAY
      AND o_orderpriority <> '5-LOW' AND o_orderkey NOT IN (SELECT event_id FROM events WHERE event_type = 'error')""",
)
def h07(t):
    kind = F.when(F.col("o_orderpriority") == "5-LOW", "TABLE PARTITION").otherwise(F.col("o_orderpriority"))
    objects = t.orders.select(
        F.col("o_custkey").cast("string").alias("owner"),
        F.concat(F.lit("OBJ"), "o_orderkey").alias("object_name"),
        kind.alias("object_type"),
        F.col("o_orderdate").alias("created"),
    )
    dropped = t.events.filter("event_type = 'error'").select(F.concat(F.lit("OBJ"), "event_id").alias("object_name"))
    return hl.recent_objects(objects, dropped, "2001-06-01", ORDERS_AS_OF, days=90)


@query(
    "h08_count_by_owner",
    "SELECT 'DB' || event_id % 3 AS database, user_id AS owner, count(*) AS recyclebin_objects FROM events GROUP BY ALL",
)
def h08(t):
    """The same owners in three databases."""
    return hl.count_by_owner(t.events.select(database("event_id"), F.col("user_id").alias("owner")), DB)


@query(
    "h09_components_down",
    """SELECT s_name AS component_name, 'AUTOMATIC' AS startup_mode, 'STOPPED' AS component_status, c_name AS queue_name
    FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey * 20 WHERE s_nationkey <> 3 AND s_acctbal < 5000""",
)
def h09(t):
    components = t.supplier.select(
        F.col("s_name").alias("component_name"),
        F.when(F.col("s_nationkey") != 3, "AUTOMATIC").otherwise("MANUAL").alias("startup_mode"),
        F.when(F.col("s_acctbal") < 5000, "STOPPED").otherwise("RUNNING").alias("component_status"),
        (F.col("s_suppkey") * 20).alias("queue_id"),
    )
    queues = t.customer.select(F.col("c_custkey").alias("queue_id"), F.col("c_name").alias("queue_name"))
    return hl.components_down(components, queues)


def parameters(t):
    name = F.when(F.col("p_size") < 10, F.concat(F.lit("log_archive_dest_"), "p_partkey")).otherwise(F.col("p_name"))
    name = F.when(F.col("p_size") < 3, F.concat(F.lit("log_archive_dest_state_"), "p_partkey")).otherwise(name)
    return t.part.select(
        database("p_partkey"),
        name.alias("name"),
        F.when(F.col("p_brand") != "Brand#7", F.col("p_brand")).alias("value"),
        F.when(F.col("p_type") == "PROMO", "FALSE").otherwise("TRUE").alias("isdefault"),
    )


PARAMS_SQL = """p AS (SELECT 'DB' || p_partkey % 3 AS database, CASE WHEN p_size < 3 THEN 'log_archive_dest_state_' || p_partkey
      WHEN p_size < 10 THEN 'log_archive_dest_' || p_partkey ELSE p_name END AS name,
      CASE WHEN p_brand <> 'Brand#7' THEN p_brand END AS value, p_type FROM part)"""


@query(
    "h10_non_default_parameters",
    f"WITH {PARAMS_SQL} SELECT database, name || ' => ' || coalesce(value, '') AS param FROM p WHERE p_type = 'PROMO'",
)
def h10(t):
    return hl.non_default_parameters(parameters(t), DB)


@query(
    "h10_archive_destinations",
    f"""WITH {PARAMS_SQL} SELECT database, rpad(name, 20, ' ') || ' => ' || value AS dest FROM p
    WHERE name LIKE 'log_archive_dest%' AND value IS NOT NULL AND name NOT LIKE '%state%'""",
)
def h10_archive(t):
    return hl.archive_destinations(parameters(t), DB)


@query(
    "h11_link_list",
    """SELECT 'DB' || s_suppkey % 3 AS database, n_name || '.' || s_name || ' =>' || s_suppkey || '@' || s_nationkey AS dblink
    FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def h11(t):
    links = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select(
        database("s_suppkey"),
        F.col("n_name").alias("owner"),
        F.col("s_name").alias("db_link"),
        F.col("s_suppkey").cast("string").alias("username"),
        F.col("s_nationkey").cast("string").alias("host"),
    )
    return hl.link_list(links, DB)


def banners(t):
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Oracle Enterprise Edition").when(
        F.col("o_orderpriority") == "2-HIGH", "Oracle Standard"
    ).otherwise(F.col("o_orderpriority"))
    return t.orders.select(F.col("o_custkey").alias("dbid"), text.alias("banner"))


@query(
    "h12_instance_card",
    f"""WITH e AS (SELECT o_custkey AS dbid, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n FROM orders GROUP BY ALL),
    i AS (SELECT c_custkey AS dbid, c_name AS instance_name, 'host' || c_nationkey AS host, '11.2.0.' || (c_custkey % 5) AS version,
      c_mktsegment || ' Little Endian' AS platform, CASE WHEN c_acctbal < 0 THEN 'NOARCHIVELOG' ELSE 'ARCHIVELOG' END AS log_mode,
      (c_custkey * 3671 + 59) AS up FROM customer)
    SELECT i.dbid, instance_name, CASE WHEN n > 0 THEN 'Enterprise Edition' WHEN n = 0 THEN 'Standard Edition' END AS edition, version,
      host, platform, log_mode, up // 86400 || ' Days ' || up // 3600 % 24 || ' Hours ' || up // 60 % 60 || ' Minutes '
      || up % 60 || ' Seconds' AS uptime FROM i LEFT JOIN e USING (dbid)""",
)
def h12(t):
    now = F.lit(ORDERS_AS_OF).cast("timestamp_ntz")
    instances = t.customer.select(
        F.col("c_custkey").alias("dbid"),
        F.col("c_name").alias("instance_name"),
        F.concat(F.lit("host"), "c_nationkey", F.lit(".example.com")).alias("host_name"),
        F.concat(F.lit("11.2.0."), F.col("c_custkey") % 5).alias("version"),
        (now - F.make_dt_interval(secs=(F.col("c_custkey") * 3671 + 59).cast("decimal(18,6)"))).alias("startup_time"),
    )
    databases = t.customer.select(
        F.col("c_custkey").alias("dbid"),
        F.when(F.col("c_acctbal") < 0, "NOARCHIVELOG").otherwise("ARCHIVELOG").alias("log_mode"),
        F.col("c_mktsegment").alias("platform_name"),
        F.lit("Little").alias("endian_format"),
    )
    return hl.instance_card(instances, databases, banners(t), ORDERS_AS_OF)


@query(
    "h13_version_number",
    """SELECT p_partkey, CAST((p_size % 3 + 10) || '' || (p_partkey % 3) AS INT) AS version_no FROM part""",
)
def h13(t):
    text = F.concat_ws(".", F.col("p_size") % 3 + 10, F.col("p_partkey") % 3, F.lit("0"), F.col("p_size"))
    return t.part.select("p_partkey", text.alias("version")).select("p_partkey", version_number("version").alias("version_no"))
