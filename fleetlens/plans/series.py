"""Metric and event-series queries over the driver tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetlens.operators import series
from fleetlens.plans.registry import AS_OF, EVENT_NOW, query, sql_values

NOW = datetime.fromisoformat(AS_OF)
ENTITY = ["user_id", "event_type"]
TODAY = "TIMESTAMP '2024-01-30'"


def metric_history(t):
    """Event values as whole hundredths, so that sums are exact in any order."""
    return t.events.select("event_id", *ENTITY, "ts", F.round(F.col("value") * 100).cast("long").alias("value"))


CENTS = "CAST(round(value * 100) AS BIGINT)"


EVENT_MAP = [("click", "WAIT: READ"), ("view", "WAIT: READ"), ("purchase", "WAIT: WRITE"), ("error", "WAIT: NETWORK")]


@query(
    "m01_collect_metrics",
    f"""WITH m AS (SELECT * FROM (VALUES {sql_values(EVENT_MAP)}) v(event, metric))
    SELECT user_id, coalesce(metric, 'WAIT: OTHER') AS metric,
      CAST(sum(CAST(value * 100 AS BIGINT)) AS BIGINT) AS value
    FROM events LEFT JOIN m ON event_type = event GROUP BY ALL""",
)
def m01(t):
    counters = t.events.select("user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("total_waits"))
    mapping = t.rows(EVENT_MAP, "event string, metric string")
    return series.collect_metrics(counters, mapping, by="user_id", event="event_type", other="WAIT: OTHER")


@query(
    "m01_metric_snapshot",
    f"""WITH m AS (SELECT * FROM (VALUES {sql_values(EVENT_MAP)}) v(event, metric)),
    w AS (SELECT user_id, coalesce(metric, 'WAIT: OTHER') AS metric, {CENTS} AS value FROM events
        LEFT JOIN m ON event_type = event WHERE event_type <> 'error'
      UNION ALL SELECT DISTINCT user_id, metric, 0 FROM (SELECT DISTINCT user_id FROM events WHERE event_type <> 'error') u,
        (SELECT metric FROM m UNION SELECT 'WAIT: OTHER') k)
    SELECT user_id, metric, CAST(sum(value) AS DOUBLE) AS value FROM w GROUP BY ALL
    UNION ALL SELECT c_custkey, 'SESSIONS: HIGHWATER', c_nationkey FROM customer
    UNION ALL SELECT o_custkey, 'SESSIONS: CURRENT', count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) FROM orders GROUP BY o_custkey
    UNION ALL SELECT p_partkey, 'STAT: ' || upper(p_type), p_size FROM part WHERE p_type IN ('SMALL', 'LARGE')
    UNION ALL SELECT p_partkey, 'STAT: BUFFER HIT RATIO', 1.0::DOUBLE - CAST(sum(CASE WHEN p_type = 'SMALL' THEN p_size ELSE 0 END) AS DOUBLE)
      / CAST(sum(p_size) AS DOUBLE) FROM part WHERE p_type IN ('SMALL', 'LARGE') GROUP BY p_partkey HAVING sum(p_size) <> 0
    UNION ALL SELECT s_suppkey, 'MEMORY: PGA', s_nationkey FROM supplier
    UNION ALL SELECT l_suppkey, 'MEMORY: SGA', round(sum(CAST(l_quantity AS BIGINT)) / 8, 3) FROM lineitem GROUP BY l_suppkey""",
)
def m01_snapshot(t):
    waits = t.events.select("user_id", F.col("event_type").alias("event"), F.round(F.col("value") * 100).cast("long").alias("total_waits"))
    return series.metric_snapshot(
        waits,
        t.orders.select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") != "P", "U").alias("username")),
        t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("sessions_highwater")),
        t.part.select(F.col("p_partkey").alias("user_id"), F.col("p_type").alias("name"), F.col("p_size").alias("value")),
        t.supplier.select(
            F.col("s_suppkey").alias("user_id"),
            F.lit("total PGA allocated").alias("name"),
            (F.col("s_nationkey") * F.lit(float(1 << 30))).alias("value"),
        ),
        t.lineitem.select(F.col("l_suppkey").alias("user_id"), (F.col("l_quantity").cast("long") * (1 << 27)).alias("bytes")),
        "user_id",
        mapping=t.rows(EVENT_MAP, "event string, metric string"),
        other="WAIT: OTHER",
        exclude=["error"],
        statistics=["SMALL", "LARGE"],
        reads=["SMALL"],
        gets=["SMALL", "LARGE"],
    )


@query(
    "m02_ratio_metric",
    f"""SELECT user_id, 1.0::DOUBLE - CAST(sum({CENTS}) FILTER (WHERE event_type = 'error') AS DOUBLE)
      / CAST(sum({CENTS}) FILTER (WHERE event_type IN ('click', 'view')) AS DOUBLE) AS ratio
    FROM events GROUP BY user_id""",
)
def m02(t):
    return series.ratio_metric(metric_history(t), "event_type", "value", ["error"], ["click", "view"], "user_id")


LAG_SQL = f"""p AS (SELECT user_id, event_type, ts, {CENTS} AS now_value, lag({CENTS}, 1) OVER w AS back_1,
      lag({CENTS}, 2) OVER w AS back_2, lag({CENTS}, 3) OVER w AS back_3, lag({CENTS}, 6) OVER w AS back_6,
      lag({CENTS}, 9) OVER w AS back_9, lag({CENTS}, 12) OVER w AS back_12 FROM events
    WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, value, event_id)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, value DESC, event_id DESC) = 1)"""


@query("m03_lag_panel", f"WITH {LAG_SQL} SELECT * FROM p")
def m03(t):
    return series.lag_panel(metric_history(t), ENTITY, "ts", "value", tie_break=["event_id"])


def _avg_sql(name: str, test: str) -> str:
    return f"""{name} AS (SELECT user_id, event_type,
      CAST(sum({CENTS}) AS DOUBLE) / count(value) AS a FROM events WHERE {test} GROUP BY ALL)"""


# Bands of days instead of minutes: the driver events are sparse.
AVG_SQL = ", ".join(
    [
        _avg_sql("b0", f"ts > {EVENT_NOW} - INTERVAL 24 HOUR"),
        _avg_sql("b1", f"ts > {EVENT_NOW} - INTERVAL 60 HOUR"),
        _avg_sql("b2", f"ts >= {EVENT_NOW} - INTERVAL 10 DAY AND ts < {EVENT_NOW} + INTERVAL 10 DAY"),
        _avg_sql("b3", f"ts >= {EVENT_NOW} - INTERVAL 20 DAY AND ts < {EVENT_NOW} + INTERVAL 10 DAY"),
        _avg_sql("b4", f"ts >= {EVENT_NOW} - INTERVAL 60 DAY AND ts < {EVENT_NOW} + INTERVAL 10 DAY"),
        _avg_sql("b5", f"ts > {TODAY}"),
        _avg_sql("b6", f"ts > {TODAY} - INTERVAL 2 DAY AND ts < {TODAY}"),
        """av AS (SELECT b5.user_id, b5.event_type, b0.a AS now_avg, b1.a AS quarter_avg, b2.a AS one_avg, b3.a AS two_avg,
      b4.a AS six_avg, b5.a AS today_avg, b6.a AS yesterday_avg FROM b5
      LEFT JOIN b0 USING (user_id, event_type) LEFT JOIN b1 USING (user_id, event_type)
      LEFT JOIN b2 USING (user_id, event_type) LEFT JOIN b3 USING (user_id, event_type)
      LEFT JOIN b4 USING (user_id, event_type) LEFT JOIN b6 USING (user_id, event_type))""",
    ]
)


def day_bands():
    return series.metric_bands(NOW, unit=timedelta(days=10))


@query("m04_window_averages", f"WITH {AVG_SQL} SELECT * FROM av")
def m04(t):
    return series.window_averages(metric_history(t), ENTITY, "ts", "value", day_bands())


@query(
    "m05_metric_panel",
    f"""WITH {LAG_SQL}, {AVG_SQL} SELECT p.*, av.* EXCLUDE (user_id, event_type) FROM p
    JOIN av USING (user_id, event_type) WHERE p.ts > {EVENT_NOW} - INTERVAL 1 DAY""",
)
def m05(t):
    return series.metric_panel(
        metric_history(t), ENTITY, "ts", "value", NOW,
        bands=day_bands(), seen_within=timedelta(days=1), tie_break=["event_id"],
    )


@query(
    "m06_counter_deltas",
    """WITH c AS (SELECT user_id, event_id, ts, CAST(round(value * 100) AS BIGINT) AS total_waits,
        CAST(round(value * 7) AS BIGINT) AS time_waited FROM events),
    l AS (SELECT *, total_waits - lag(total_waits) OVER w AS snap_waits, time_waited - lag(time_waited) OVER w AS snap_waited
      FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT *, CASE WHEN snap_waits <> 0 THEN CAST(snap_waited AS DOUBLE) / CAST(snap_waits AS DOUBLE) END AS wait_average
    FROM l WHERE snap_waits >= 0""",
)
def m06(t):
    counters = t.events.select(
        "user_id",
        "event_id",
        "ts",
        F.round(F.col("value") * 100).cast("long").alias("total_waits"),
        F.round(F.col("value") * 7).cast("long").alias("time_waited"),
    )
    return series.counter_deltas(counters, "user_id", ["event_id"], "total_waits", "time_waited")


_HOURS = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24))


@query(
    "m07_hour_of_day_matrix",
    f"""SELECT CAST(ts AS DATE) AS day, {_HOURS} FROM events
    WHERE CAST(ts AS DATE) > {EVENT_NOW} - INTERVAL 8 DAY GROUP BY ALL""",
)
def m07(t):
    return series.hour_of_day_matrix(t.events, "ts", NOW)


def log_history(t):
    """Three log threads; the event id is the switch sequence."""
    return t.events.select(
        (F.col("user_id") % 3).alias("thread"), F.col("event_id").alias("sequence"), F.col("ts").alias("first_time")
    )


@query(
    "m08_burst_check",
    """SELECT user_id % 3 AS thread, date_trunc('hour', ts) AS hour, count(*) AS events FROM events
    GROUP BY ALL HAVING count(*) > 6""",
)
def m08(t):
    return series.burst_check(log_history(t), "thread", "first_time", limit=6)


@query(
    "m09_gap_check",
    f"""WITH l AS (SELECT user_id % 3 AS thread, ts, lag(ts) OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS before
      FROM events), g AS (SELECT thread, round(max((epoch_us(ts) - epoch_us(before)) / 1000000.0), 2) AS gap_seconds
      FROM l WHERE before IS NOT NULL AND ts > {EVENT_NOW} - INTERVAL 20 DAY GROUP BY thread)
    SELECT *, 3600.0::DOUBLE AS target, 'ARCHIVE_LOG_TARGET' AS target_type,
      CASE WHEN gap_seconds > 3600 THEN 'ERROR' ELSE 'OK' END AS status FROM g""",
)
def m09(t):
    return series.gap_check(
        log_history(t), "thread", ["sequence"], "first_time", since=NOW - timedelta(days=20), target_s=3600
    )


@query(
    "m09_log_switch_verdict",
    f"""WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    g AS (SELECT user_id, round(max((epoch_us(ts) - epoch_us(before)) / 1000000.0), 2) AS gap_seconds, 86400.0::DOUBLE AS target,
      '1 DAY' AS target_type FROM l WHERE before IS NOT NULL AND ts > {EVENT_NOW} - INTERVAL 20 DAY GROUP BY user_id),
    b AS (SELECT DISTINCT user_id FROM (SELECT user_id FROM events GROUP BY user_id, date_trunc('hour', ts) HAVING count(*) > 2))
    SELECT coalesce(g.user_id, b.user_id) AS user_id, gap_seconds, target, target_type, CASE WHEN b.user_id IS NOT NULL THEN 'WARNING'
      WHEN gap_seconds > target THEN 'ERROR' ELSE 'OK' END AS verdict FROM g FULL JOIN b ON g.user_id = b.user_id""",
)
def m09_verdict(t):
    events = t.events.select("user_id", "event_id", "ts")
    return series.log_switch_verdict(events, "user_id", ["event_id"], "ts", since=NOW - timedelta(days=20), limit=2)


@query(
    "m10_peak_daily_volume",
    """SELECT max(round(n * (SELECT CAST(sum(l_quantity * 1048576) AS DOUBLE) / count(*) FROM lineitem) / 1024 / 1024))
      AS peak_mb FROM (SELECT count(*) AS n FROM events GROUP BY CAST(ts AS DATE))""",
)
def m10(t):
    sizes = t.lineitem.select((F.col("l_quantity") * 1048576).alias("bytes"))
    return series.peak_daily_volume(t.events, sizes, "ts", "bytes")


@query(
    "m11_humanise_bytes",
    """WITH b AS (SELECT o_orderkey, o_totalprice * 5000 AS bytes FROM orders)
    SELECT o_orderkey, CASE WHEN bytes > 1073741823 THEN CAST(round(bytes / 1073741824.0) AS BIGINT) || ' GB'
      ELSE CAST(round(bytes / 1048576.0) AS BIGINT) || ' MB' END AS size_text FROM b""",
)
def m11(t):
    from fleetlens.functions.semantics import humanise_bytes

    return t.orders.select("o_orderkey", humanise_bytes(F.col("o_totalprice") * 5000).alias("size_text"))


@query(
    "m12_sample_rollup",
    f"""SELECT user_id, event_type, date_trunc('hour', ts) AS hour, count(value) AS samples,
      CAST(sum({CENTS}) AS DOUBLE) / count(value) AS mean_value, min({CENTS}) AS min_value, max({CENTS}) AS max_value
    FROM events GROUP BY ALL""",
)
def m12(t):
    return series.sample_rollup(metric_history(t), ENTITY, "ts", "value")
