"""Line classification and notification queries: events as report lines per user."""

from datetime import timedelta

from pyspark.sql import functions as F

from fleetlens.functions.semantics import ntz
from fleetlens.operators import alerts as al
from fleetlens.plans.capacity import CONTAINER_SQL, usage
from fleetlens.plans.registry import AS_OF, EVENT_NOW, query
from fleetlens.sinks.tables import settled

HALF = "2024-01-16 00:00:00"


def report_lines(t):
    """A report line per event: what a morning check prints, chosen by type and value."""
    kind, v = F.col("event_type"), F.col("value")
    target = F.concat(F.lit("DB"), "user_id")
    line = (
        F.when(kind == "error", F.concat(F.lit("** ERROR - tablespace alerts on "), target))
        .when((kind == "click") & (v < 50), F.concat(F.lit("-- Last Database Backup FAILURE on "), target))
        .when(kind == "click", F.concat(F.lit("Redo completed (in "), v.cast("decimal(18,2)"), F.lit(" s)")))
        .when((kind == "view") & (v > 100), F.concat(F.lit("** no RMAN alerts for "), target, F.lit(" **")))
        .when(kind == "view", F.lit("3 successes and failures of 4"))
        .when((kind == "purchase") & (v < 30), F.lit("UNDO (u) ERROR 92 [XXXXXXXXXXXXXXXXXX--]"))
        .when((kind == "purchase") & (v < 90), F.lit("USERS 97 [xxxxxxxxxxxxxxxxxxx-]"))
        .when(kind == "purchase", F.lit("USERS 60 [XXXXXXXXXXXX--------]"))
        .when(v < 20, F.lit("+ Summary of checks +"))
        .when(v < 60, F.lit("** WARNING - 2 users found **"))
        .when(v < 120, F.lit("Database is in NOARCHIVELOG Mode"))
        .otherwise(F.lit("All quiet"))
    )
    return t.events.select("event_id", "ts", target.alias("target"), line.alias("line"))


LINES_SQL = """ln AS (SELECT event_id, ts, 'DB' || user_id AS target, CASE
      WHEN event_type = 'error' THEN '** ERROR - tablespace alerts on DB' || user_id
      WHEN event_type = 'click' AND value < 50 THEN '-- Last Database Backup FAILURE on DB' || user_id
      WHEN event_type = 'click' THEN 'Redo completed (in ' || CAST(value AS DECIMAL(18,2)) || ' s)'
      WHEN event_type = 'view' AND value > 100 THEN '** no RMAN alerts for DB' || user_id || ' **'
      WHEN event_type = 'view' THEN '3 successes and failures of 4'
      WHEN event_type = 'purchase' AND value < 30 THEN 'UNDO (u) ERROR 92 [XXXXXXXXXXXXXXXXXX--]'
      WHEN event_type = 'purchase' AND value < 90 THEN 'USERS 97 [xxxxxxxxxxxxxxxxxxx-]'
      WHEN event_type = 'purchase' THEN 'USERS 60 [XXXXXXXXXXXX--------]'
      WHEN value < 20 THEN '+ Summary of checks +' WHEN value < 60 THEN '** WARNING - 2 users found **'
      WHEN value < 120 THEN 'Database is in NOARCHIVELOG Mode' ELSE 'All quiet' END AS line FROM events)"""
BAR = r"\[X{18}--\]$|\[X{19}-\]$| \[X{20}\]$"
CLASS_SQL = rf"""{LINES_SQL}, qt AS (SELECT DISTINCT target FROM ln WHERE contains(lower(line), 'no rman alerts for ' || lower(target))),
    cl AS (SELECT ln.*, CASE WHEN contains(line, '+') AND contains(line, 'Summary') THEN 'HEADING'
      WHEN contains(line, 'successes and failures') THEN 'NEUTRAL' WHEN contains(line, 'WARNING') THEN 'WARNING'
      WHEN contains(line, 'NOARCHIVELOG') THEN 'WARNING'
      WHEN regexp_matches(line, '\((u|t)\)') AND regexp_matches(line, '(?i){BAR}') THEN 'WARNING'
      WHEN regexp_matches(line, '(?i){BAR}') THEN 'ERROR'
      WHEN qt.target IS NOT NULL AND regexp_matches(line, '(?i)backup failure') THEN 'WARNING'
      WHEN regexp_matches(line, '(?i)ERROR|FAIL') THEN 'ERROR' ELSE 'NEUTRAL' END AS level,
      CASE WHEN regexp_matches(line, '\((u|t)\)') AND regexp_matches(line, '(?i){BAR}') THEN replace(line, 'ERROR', 'WARNING')
        ELSE line END AS shown FROM ln LEFT JOIN qt USING (target))"""


def classified(t):
    return al.classify_lines(report_lines(t))


@query("a01_classify_lines", f"WITH {CLASS_SQL} SELECT * FROM cl")
def a01(t):
    return classified(t)


@query(
    "a02_severity_counts",
    f"""WITH {CLASS_SQL} SELECT target, count(*) FILTER (WHERE level = 'WARNING') AS warning_count,
      count(*) FILTER (WHERE level = 'ERROR') AS error_count FROM cl GROUP BY target""",
)
def a02(t):
    return al.severity_counts(classified(t))


@query(
    "a03_follow_ups",
    f"WITH {LINES_SQL} SELECT DISTINCT target FROM ln WHERE contains(line, 'ERROR - tablespace alerts')",
)
def a03(t):
    return al.follow_ups(classified(t))


@query(
    "a03_follow_up_usage",
    f"""WITH {LINES_SQL}, {CONTAINER_SQL} SELECT database_name, container, kind, pct_used FROM usage
    WHERE pct_used > 40 AND database_name IN (SELECT target FROM ln WHERE contains(line, 'ERROR - tablespace alerts'))""",
)
def a03_usage(t):
    found = al.follow_up_usage(classified(t), usage(t), min_pct=40)
    return found.select("database_name", "container", "kind", "pct_used")


def notify(t, **kw):
    lines = report_lines(t).withColumn("is_error", F.col("line").rlike(al.ANY_ERROR))
    current = lines.filter(F.col("ts") >= ntz(HALF))
    previous = lines.filter(F.col("ts") < ntz(HALF))
    last = lines.groupBy("target").agg(F.min("ts").alias("notified_at"))
    return al.notify_on_change(current, previous, last, AS_OF, reminder=timedelta(days=29, hours=23), **kw)


def notify_sql(remind: str) -> str:
    return f"""WITH {LINES_SQL}, nm AS (SELECT target, split_part(line, '(', 1) AS line, ts, line AS raw FROM ln),
    dl AS (SELECT target, line, sum(CASE WHEN ts >= TIMESTAMP '{HALF}' THEN 1 ELSE -1 END) AS net FROM nm
      WHERE NOT contains(raw, 'completed') GROUP BY ALL),
    ch AS (SELECT target, bool_or(net <> 0) AS changed FROM dl GROUP BY target),
    er AS (SELECT target, bool_or(regexp_matches(line, '(?i)ERROR|FAIL')) AS in_error FROM ln
      WHERE ts >= TIMESTAMP '{HALF}' GROUP BY target),
    ls AS (SELECT target, min(ts) < {EVENT_NOW} - INTERVAL 29 DAY - INTERVAL 23 HOUR AS overdue FROM ln GROUP BY target)
    SELECT target, coalesce(in_error, false) AS in_error, CASE WHEN changed THEN 'CHANGED'
      WHEN {remind} THEN 'REMINDER' ELSE 'NONE' END AS decision
    FROM ch FULL JOIN er USING (target) LEFT JOIN ls USING (target)"""


@query("a04_notify_on_change", notify_sql("overdue AND coalesce(in_error, false)"))
def a04(t):
    return notify(t)


@query("a04_notify_reminding_always", notify_sql("overdue"))
def a04_always(t):
    return notify(t, remind_only_if_error=False)


@query(
    "a05_slow_runs",
    """WITH r AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, min(ts) AS started, max(ts) AS ended FROM events GROUP BY ALL)
    SELECT *, (epoch_us(ended) - epoch_us(started)) / 1000000.0::DOUBLE AS elapsed_seconds,
      CASE WHEN (epoch_us(ended) - epoch_us(started)) / 1000000.0::DOUBLE > 60 THEN 'WARNING' ELSE 'OK' END AS level FROM r""",
)
def a05(t):
    runs = t.events.groupBy("user_id", "event_type", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("started"), F.max("ts").alias("ended")
    )
    return al.slow_runs(runs)


def probes(t):
    results = t.orders.select(
        F.col("o_custkey").alias("target"),
        F.col("o_orderkey").alias("probe"),
        (F.col("o_orderstatus") != "P").alias("ping_ok"),
        (F.col("o_totalprice") / 25).alias("ping_ms"),
        (F.col("o_orderpriority") != "1-URGENT").alias("login_ok"),
    )
    skips = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("target"), F.col("c_mktsegment").alias("reason"))
    return al.probe_status(results, skips)


PROBE_SQL = """pr AS (SELECT o_custkey AS target, CASE WHEN c_custkey IS NOT NULL THEN 'SKIPPED' WHEN o_orderstatus = 'P' THEN 'ERROR'
      WHEN o_totalprice / 25 > 10000 THEN 'WARNING' WHEN o_orderpriority = '1-URGENT' THEN 'ERROR' ELSE 'OK' END AS status,
      CASE WHEN c_custkey IS NOT NULL THEN 'Intentionally skipped (' || c_mktsegment || ')'
        WHEN o_orderstatus = 'P' OR o_totalprice / 25 > 10000 THEN 'Unable to tnsping'
        WHEN o_orderpriority = '1-URGENT' THEN 'Failed to connect' ELSE 'Looks OK' END AS note
      FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0)"""


@query("a06_probe_status", f"WITH {PROBE_SQL} SELECT * FROM pr")
def a06(t):
    return probes(t)


@query(
    "a06_report_status",
    f"""WITH {PROBE_SQL} SELECT target, CASE max(CASE status WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END)
      WHEN 2 THEN 'ERROR' WHEN 1 THEN 'WARNING' ELSE 'OK' END AS status FROM pr GROUP BY target""",
)
def a06_report(t):
    return al.report_status(probes(t), "target")


def document_lines(t):
    return t.documents.select(F.col("doc_id").alias("target"), F.explode(F.split("text", "\n")).alias("line"))


@query(
    "a07_text_verdict",
    r"""WITH ln AS (SELECT doc_id AS target, unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT target, count(*) FILTER (WHERE regexp_matches(line, 'NOT OK|the|que')) AS failing_lines,
      count(*) FILTER (WHERE NOT regexp_matches(line, 'NOT OK|the|que') AND contains(line, 'an')) AS marked_lines,
      count(*) AS lines, CASE WHEN count(*) FILTER (WHERE regexp_matches(line, 'NOT OK|the|que')) > 0 THEN 'NOT OK' ELSE 'OK' END AS verdict
    FROM ln GROUP BY target""",
)
def a07(t):
    return al.text_verdict(document_lines(t), failing="NOT OK|the|que", marked="an")


@query(
    "a08_error_histogram",
    r"""WITH ln AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    SELECT line, count(*) AS occurrences FROM ln WHERE regexp_matches(line, '(?i)and|ein|FAILED') AND NOT contains(line, '(WARN)')
    GROUP BY line""",
)
def a08(t):
    return al.error_histogram(document_lines(t), pattern="(?i)and|ein|FAILED")


@query(
    "a08_daily_sketches",
    """SELECT user_id % 3 AS part, event_type || ' ' || user_id % 40 AS line, count(*) AS occurrences FROM events
    WHERE event_type <> 'view' GROUP BY ALL""",
)
def a08_sketches(t):
    """Sketches of each day and part, stored, read back and merged over the days."""
    line = F.concat_ws(" ", "event_type", (F.col("user_id") % 40).cast("string"))
    rows = t.events.select(F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("part"), line.alias("line"))
    sketches = settled(al.error_sketches(rows, ["day", "part"], pattern="^(?!view)"), "sketches")
    return al.most_frequent(sketches, 1000, "part")


@query("a09_extract_severe", f"WITH {CLASS_SQL} SELECT * FROM cl WHERE level IN ('HEADING', 'WARNING', 'ERROR')")
def a09(t):
    return al.extract_severe(classified(t))
