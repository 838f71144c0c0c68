"""Table-maintenance queries over the driver tables."""

import uuid

from pyspark.sql import functions as F

from fleetlens.operators.latest import latest_per_key
from fleetlens.plans.registry import AS_OF, query
from fleetlens.sinks import tables


def scratch(t, name: str) -> str:
    """A new folder for one run, in the cluster's shared folder."""
    return f"{tables.shared_folder(t.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def event_rows(t):
    return t.events.select("event_id", "user_id", "event_type", "value")


@query(
    "s01_upsert",
    """WITH s AS (SELECT event_id * 2 AS event_id, user_id, event_type, value + 1 AS value FROM events)
    SELECT coalesce(e.event_id, s.event_id) AS event_id, CASE WHEN e.event_id IS NULL THEN s.user_id ELSE e.user_id END AS user_id,
      CASE WHEN e.event_id IS NULL THEN s.event_type ELSE e.event_type END AS event_type,
      CASE WHEN s.event_id IS NULL THEN e.value ELSE s.value END AS value
    FROM events e FULL JOIN s ON e.event_id = s.event_id""",
)
def s01(t):
    source = event_rows(t).withColumn("event_id", F.col("event_id") * 2).withColumn("value", F.col("value") + 1)
    return tables.upsert(event_rows(t), source, "event_id", ["value"])


@query(
    "s02_update_matching",
    """SELECT s_suppkey, s_name, CASE WHEN c_custkey IS NULL THEN s_acctbal ELSE c_acctbal END AS s_acctbal
    FROM supplier LEFT JOIN customer ON c_custkey = s_suppkey AND c_nationkey = s_nationkey""",
)
def s02(t):
    source = t.customer.select(
        F.col("c_custkey").alias("s_suppkey"),
        F.col("c_nationkey").alias("s_nationkey"),
        F.col("c_acctbal").alias("s_acctbal"),
    )
    new = tables.update_matching(t.supplier, source, ["s_suppkey", "s_nationkey"], ["s_acctbal"])
    return new.select("s_suppkey", "s_name", "s_acctbal")


@query("s03_append", "SELECT event_type, 2 * count(*) AS stored FROM events GROUP BY ALL")
def s03(t):
    path = scratch(t, "append")
    for _ in range(2):
        tables.append(event_rows(t), path, ["event_type"])
    return t.spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("stored"))


@query(
    "s03_write_history",
    """SELECT event_id, user_id, event_type, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00'""",
)
def s03_history(t):
    path = scratch(t, "history")
    rows = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    tables.write_history(rows, path, "ts", ["user_id", "event_type"])
    return tables.read_history(t.spark, path, "ts", "2024-01-10 12:00:00")


def clustered_events(t):
    """Events as a history table clustered by user and type."""
    table = "clustered_" + uuid.uuid4().hex
    rows = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    tables.write_clustered(rows, table, ["user_id", "event_type"], "ts", 16, scratch(t, "clustered"))
    return t.spark.table(table)


@query(
    "s03_clustered_history",
    """SELECT user_id, event_type, event_id, ts, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""",
)
def s03_clustered(t):
    rows = latest_per_key(clustered_events(t), ["user_id", "event_type"], "ts", ["event_id"])
    return rows.select("user_id", "event_type", "event_id", "ts", "value")


@query(
    "s04_append_changed",
    """WITH h AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
    s AS (SELECT o_custkey, o_orderpriority, o_orderstatus FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT s.* FROM s LEFT JOIN h USING (o_custkey) WHERE h.o_custkey IS NULL
      OR (s.o_orderpriority, s.o_orderstatus) IS DISTINCT FROM (h.o_orderpriority, h.o_orderstatus)""",
)
def s04(t):
    watched = ["o_orderpriority", "o_orderstatus"]
    history = t.orders.select("o_custkey", "o_orderkey", "o_orderdate", *watched)
    source = tables.dedupe_source(history, "o_custkey", ["o_orderkey"]).select("o_custkey", *watched)
    return tables.append_changed(history, source, "o_custkey", watched, "o_orderdate", ["o_orderkey"])


@query(
    "s05_purge",
    """SELECT event_id, user_id, event_type, ts FROM events
    WHERE NOT (ts < TIMESTAMP '2024-01-30' - INTERVAL 14 DAY AND event_type <> 'error')""",
)
def s05(t):
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return tables.purge(rows, "ts", AS_OF, days=14, only=F.col("event_type") != "error")


@query(
    "s06_open_alert_once",
    """SELECT o_custkey AS database_id, o_orderdate AS created, o_orderkey AS note FROM orders
    WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
def s06(t):
    alerts = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("database_id"))
    candidates = t.orders.select(
        F.col("o_custkey").alias("database_id"), F.col("o_orderdate").alias("created"), F.col("o_orderkey").alias("note")
    )
    return tables.open_alert_once(alerts, candidates, "database_id", ["created", "note"])


@query(
    "s07_route_by_weekday",
    """SELECT 'month' AS target, event_id, ts FROM events
    UNION ALL SELECT 'main', event_id, ts FROM events WHERE strftime(ts, '%a') IN ('Mon', 'Thu')""",
)
def s07(t):
    month, main = tables.route_by_weekday(t.events.select("event_id", "ts"), "ts", ["Mon", "Thu"])
    return month.select(F.lit("month").alias("target"), "event_id", "ts").unionByName(
        main.select(F.lit("main").alias("target"), "event_id", "ts")
    )


@query("s08_dedupe_source", "SELECT DISTINCT o_custkey, o_orderpriority, o_orderstatus FROM orders")
def s08(t):
    return tables.dedupe_source(t.orders.select("o_custkey", "o_orderpriority", "o_orderstatus"))


@query(
    "s08_dedupe_by_key",
    """SELECT o_custkey, o_orderkey, o_totalprice FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1""",
)
def s08_key(t):
    rows = t.orders.select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.dedupe_source(rows, "o_custkey", ["o_totalprice", "o_orderkey"])
