"""Streaming queries: the event table read as a stream, written to a table, and read back."""

from pyspark.sql import functions as F

from fleetlens.plans.inventory import RULE_SQL, rule_sql, rule_table
from fleetlens.plans.registry import query
from fleetlens.plans.tables import scratch
from fleetlens.streaming import operators as st
from fleetlens.streaming import stateful as sf


def event_stream(t):
    """The event table as a stream, whether it is one file or a folder of files."""
    reader = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", FILES_PER_BATCH)
    return reader.option("recursiveFileLookup", "true").parquet(f"{t.folder}/events.parquet*")


FILES_PER_BATCH = 64


def windows_of(t, name, windows, stream):
    """Windows close a day after their end; what comes later is merged in the end."""
    path = scratch(t, name)
    kept = st.WindowTables(windows, path, "1 DAY")
    st.drain(stream, kept.store, path + "/checkpoint")
    return kept.current(t.spark)


def drained(t, name, stream, mode="append"):
    """Result table of a stream that has processed everything available."""
    path = scratch(t, name)
    st.write_available(stream, path + "/table", path + "/checkpoint", mode)
    return t.spark.read.parquet(path + "/table")


def recomputed(t, name, stream, compute):
    path = scratch(t, name)
    st.drain(stream, st.recomputed(path + "/history", path + "/table", "key", compute), path + "/checkpoint")
    return t.spark.read.parquet(path + "/table").drop("bucket")


def exact(stream):
    return stream.withColumn("value", F.col("value").cast("decimal(18,2)"))


@query(
    "t01_sliding_averages",
    f"""WITH e AS (SELECT *, unnest(range(0, 24, 6)) AS back FROM events),
    w AS (SELECT *, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') - to_hours(CAST(back AS INT)) AS window_start FROM e)
    SELECT event_type, window_start, window_start + INTERVAL 24 HOUR AS window_end, count(value) AS samples,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean_value FROM w
    GROUP BY ALL""",
)
def t01(t):
    return windows_of(t, "sliding", st.sliding_averages("event_type", "ts", "value", "24 hours", "6 hours"), exact(event_stream(t)))


@query(
    "t02_daily_high_water",
    f"""SELECT user_id, event_type, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS window_start, value, ts, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE) ORDER BY value DESC, ts, event_id DESC) = 1""",
)
def t02(t):
    windows = st.windowed_high_water(["user_id", "event_type"], "ts", "value", tie_break=["event_id"])
    return windows_of(t, "high", windows, event_stream(t)).drop("window_end")


@query(
    "t02_hourly_rollup",
    f"""SELECT event_type, date_trunc('hour', ts) AS window_start, count(value) AS samples,
      CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean_value, CAST(min(value) AS DECIMAL(18,2)) AS min_value,
      CAST(max(value) AS DECIMAL(18,2)) AS max_value FROM events GROUP BY ALL""",
)
def t02_rollup(t):
    return windows_of(t, "rollup", st.windowed_rollup("event_type", "ts", "value"), exact(event_stream(t))).drop("window_end")


def series_stream(t, **cols):
    stream = st.zoned(event_stream(t), "ts")
    return stream.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "ts", *[c.alias(n) for n, c in cols.items()])


def naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# Walks each user's events in order: the state is what was last seen, the notice when it was last told.
@query(
    "t03_notify_changes",
    """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    r AS (SELECT user_id, event_id, ts, event_type, n, ts AS told, 'CHANGED' AS decision FROM o WHERE n = 1
      UNION ALL SELECT o.user_id, o.event_id, o.ts, o.event_type, o.n,
        CASE WHEN o.event_type <> r.event_type OR (o.event_type = 'error' AND o.ts - r.told > INTERVAL 6 HOUR) THEN o.ts ELSE r.told END,
        CASE WHEN o.event_type <> r.event_type THEN 'CHANGED'
          WHEN o.event_type = 'error' AND o.ts - r.told > INTERVAL 6 HOUR THEN 'REMINDER' ELSE 'NONE' END
      FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id AS key, event_id AS seq, ts, event_type AS state, decision FROM r WHERE decision <> 'NONE'""",
)
def t03(t):
    states = series_stream(t, state=F.col("event_type"))
    return naive(recomputed(t, "notify", states, lambda rows: sf.notices(rows, "error", 6 * 3600)))


HORIZON_SQL = "h AS (SELECT max(ts) - INTERVAL 1 DAY AS upto FROM events)"


@query(
    "t03_reminder_timers",
    f"""WITH {HORIZON_SQL}, o AS (SELECT user_id, ts, event_id, event_type,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events, h WHERE ts <= upto),
    c AS (SELECT user_id, ts, event_type, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until FROM o WHERE event_type IS DISTINCT FROM before),
    r AS (SELECT user_id, ts, event_type, unnest(generate_series(ts + INTERVAL 6 HOUR, coalesce(until - INTERVAL 1 MICROSECOND, upto), INTERVAL 6 HOUR)) AS due
      FROM c, h WHERE event_type = 'error')
    SELECT user_id AS key, ts, event_type AS state, 'CHANGED' AS decision FROM c
    UNION ALL SELECT user_id, due, event_type, 'REMINDER' FROM r""",
)
def t03_timers(t):
    """Up to a day before the last event: that is how far the watermark gets."""
    sf.use_rocksdb(t.spark)
    states = series_stream(t, value=F.col("event_type"))
    return naive(drained(t, "timers", sf.notices_in_order(states, "1 day", "error", 6 * 3600)))


@query(
    "t04_samples_ago",
    """SELECT user_id AS key, ts, value AS now_value, lag(value, 1) OVER w AS back_1, lag(value, 2) OVER w AS back_2,
      lag(value, 3) OVER w AS back_3, lag(value, 6) OVER w AS back_6, lag(value, 9) OVER w AS back_9, lag(value, 12) OVER w AS back_12
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, value, event_id)
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, value DESC, event_id DESC) = 1""",
)
def t04(t):
    """The panel is emitted anew by each micro-batch, so each batch replaces the one before."""
    sf.use_rocksdb(t.spark)
    path = scratch(t, "panel")
    panel = sf.samples_ago(series_stream(t, value=F.col("value")))
    st.drain(panel, st.stored_by_batch(path + "/table", lambda batch: batch), path + "/checkpoint", "update")
    return naive(sf.newest_panels(t.spark.read.parquet(path + "/table")))


@query(
    "t05_counter_deltas",
    """WITH l AS (SELECT user_id AS key, event_id AS seq, ts, CAST(round(value * 100) AS BIGINT)
      - lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events)
    SELECT * FROM l WHERE delta >= 0""",
)
def t05(t):
    counters = series_stream(t, value=F.round(F.col("value") * 100).cast("long"))
    return naive(recomputed(t, "deltas", counters, sf.deltas))


@query(
    "t05_deltas_in_order",
    f"""WITH {HORIZON_SQL}, l AS (SELECT user_id AS key, event_id AS seq, ts, CAST(round(value * 100) AS BIGINT)
      - lag(CAST(round(value * 100) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events)
    SELECT l.* FROM l, h WHERE delta >= 0 AND ts <= upto""",
)
def t05_in_order(t):
    sf.use_rocksdb(t.spark)
    counters = series_stream(t, value=F.round(F.col("value") * 100).cast("long"))
    return naive(drained(t, "deltas-in-order", sf.deltas_in_order(counters, "1 day")))


@query("t06_ingest_once", "SELECT event_id, user_id, ts, value FROM events")
def t06(t):
    """Every event arrives twice and is kept once."""
    rows = event_stream(t).select("event_id", "user_id", "ts", "value")
    twice = rows.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    path = scratch(t, "ingest")
    st.drain(twice.drop("copy"), st.ingest_once(path + "/table", ["event_id", "user_id"], "ts"), path + "/checkpoint")
    return t.spark.read.parquet(path + "/table").drop(st.DAY)


@query("t06_upsert_batches", "SELECT event_id, user_id, event_type, value + 1 AS value FROM events")
def t06_upsert(t):
    """A table of events is upserted from a stream of the same events with other values."""
    path = scratch(t, "upsert")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    cols = ["event_id", "user_id", "event_type", "value"]
    t.events.select(*cols).write.partitionBy("event_type").option("path", path + "/table").saveAsTable(table)
    changed = event_stream(t).select(*cols).withColumn("value", F.col("value") + 1)
    st.drain(changed, st.upsert_batches(table, ["event_id", "event_type"], ["user_id", "value"], "event_type", ["value"]), path + "/checkpoint")
    return t.spark.table(table).select(*cols)


@query(
    "t07_suppress_blackouts",
    f"""WITH {RULE_SQL} SELECT event_id, c_mktsegment AS database_name, ts FROM events JOIN customer ON c_custkey = user_id
    WHERE NOT EXISTS (SELECT 1 FROM r WHERE database_name = c_mktsegment AND {rule_sql('ts')})""",
)
def t07(t):
    names = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("database_name"))
    alerts = event_stream(t).join(names, "user_id").select("event_id", "database_name", "ts")
    path = scratch(t, "quiet")
    st.drain(alerts, st.suppress_blackouts(path + "/table", lambda: rule_table(t), "ts"), path + "/checkpoint")
    return t.spark.read.parquet(path + "/table").drop("batch")
