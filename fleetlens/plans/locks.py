"""Lock and session queries: events as sessions, a user's day as the locked resource."""

from pyspark.sql import functions as F

from fleetlens.functions.semantics import ntz, seconds_between
from fleetlens.operators import locks as lk
from fleetlens.plans.registry import AS_OF, EVENT_NOW, query


DB = "database"


def database():
    return F.concat(F.lit("DB"), F.col("user_id") % 3).alias(DB)


def in_each(df):
    """Rows that every one of the three databases has, with its number."""
    return df.withColumn("n", F.explode(F.array(*[F.lit(i) for i in range(3)]))).withColumn(DB, F.concat(F.lit("DB"), "n"))


def locks(t):
    kind = F.col("event_type")
    return t.events.select(
        database(),
        F.col("event_id").alias("sid"),
        F.floor(F.col("user_id") / 3).alias("id1"),
        F.dayofmonth("ts").alias("id2"),
        F.when(kind == "error", 1).otherwise(0).alias("block"),
        F.when(kind == "click", 6).otherwise(0).alias("request"),
    )


def sessions(t):
    kind = F.col("event_type")
    return t.events.select(
        database(),
        F.col("event_id").alias("sid"),
        F.col("user_id").alias("serial"),
        F.when(kind != "purchase", F.concat(F.lit("U"), "user_id")).alias("username"),
        F.lit("os").alias("osuser"),
        F.concat(F.lit("host"), "user_id", F.lit(".example.com")).alias("machine"),
        F.concat(kind, F.lit(".exe")).alias("program"),
        F.col("ts").alias("logon_time"),
        F.floor(seconds_between(ntz(AS_OF), F.col("ts"))).alias("last_call_et"),
        F.when(F.col("value") < 5, "BACKGROUND").otherwise("USER").alias("type"),
        (F.col("event_id") % 1000).alias("paddr"),
        F.when(kind != "error", F.col("user_id")).alias("sql_id"),
        (F.col("user_id") + 1).alias("prev_sql_id"),
    )


def procs(t):
    return in_each(t.customer).select(DB, F.col("c_custkey").alias("addr"), (F.col("c_custkey") + 5000 + F.col("n")).alias("spid"))


def statements(t):
    text = F.concat("source", F.lit(" "), "lang", F.lit(" "), "n")
    return in_each(t.documents).select(DB, F.col("doc_id").alias("sql_id"), text.alias("sql_text"))


BASE_SQL = f"""l AS (SELECT 'DB' || user_id % 3 AS database, event_id AS sid, user_id // 3 AS id1, day(ts) AS id2, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS block,
      CASE WHEN event_type = 'click' THEN 6 ELSE 0 END AS request FROM events),
    s AS (SELECT 'DB' || user_id % 3 AS database, event_id AS sid, user_id AS serial, CASE WHEN event_type <> 'purchase' THEN 'U' || user_id END AS username,
      'os' AS osuser, 'host' || user_id AS machine, event_type AS program, ts AS logon_time,
      (epoch_us({EVENT_NOW}) - epoch_us(ts)) // 1000000 AS last_call_et,
      CASE WHEN value < 5 THEN 'BACKGROUND' ELSE 'USER' END AS type, event_id % 1000 AS paddr,
      CASE WHEN event_type <> 'error' THEN user_id END AS sql_id, user_id + 1 AS prev_sql_id FROM events),
    p AS (SELECT 'DB' || n AS database, c_custkey AS addr, c_custkey + 5000 + n AS spid FROM customer, range(3) r(n)),
    q AS (SELECT 'DB' || n AS database, doc_id AS sql_id, source || ' ' || lang || ' ' || n AS sql_text FROM documents, range(3) r(n))"""


def text_sql(prefix: str, process: bool = True) -> str:
    tail = "|| ' SERIAL#=' || serial || ' [OSPID:' || spid || ']'" if process else ""
    return f"""'{prefix}' || coalesce(username, '') || ' (' || osuser || ') on ' || machine || ' (SID=' || s.sid {tail}
      || ') using: ' || program || ' since ' || strftime(logon_time, '%d %b %Y %H:%M:%S') || ' (last call: '
      || CAST(round(last_call_et / 60.0::DOUBLE) AS BIGINT) || ' mins ago)' AS description"""


@query(
    "k01_blockers",
    f"""WITH {BASE_SQL} SELECT DISTINCT s.database, s.sid, {text_sql('-- BLOCKER => ')}, last_call_et / 60.0::DOUBLE AS minutes
    FROM l JOIN s ON l.sid = s.sid AND l.database = s.database JOIN p ON paddr = addr AND p.database = s.database WHERE block = 1 AND type <> 'BACKGROUND'""",
)
def k01(t):
    return lk.blockers(locks(t), sessions(t), procs(t), DB)


HOLD_SQL = "h AS (SELECT l.database, l.sid, id1, id2, logon_time FROM l JOIN s ON s.sid = l.sid AND s.database = l.database WHERE block = 1 AND type <> 'BACKGROUND')"


@query(
    "k02_blocked_waiters",
    f"""WITH {BASE_SQL}, {HOLD_SQL}, w AS (SELECT database, id1, id2, count(DISTINCT sid) AS holders,
      arg_min(sid, struct_pack(a := logon_time, b := sid)) AS holder_sid FROM h GROUP BY ALL)
    SELECT l.database, holder_sid, holders, s.sid AS waiter_sid, id1, id2, {text_sql('---- BLOCKED => ', False)},
      last_call_et / 60.0::DOUBLE AS blocked_mins
    FROM l JOIN w USING (database, id1, id2) JOIN s ON s.sid = l.sid AND s.database = l.database WHERE request > 0""",
)
def k02(t):
    return lk.blocked_waiters(locks(t), sessions(t), DB)


@query(
    "k02_lock_edges",
    f"""WITH {BASE_SQL}, {HOLD_SQL}, e AS (SELECT database, sid, id1, id2, 'holds' AS edge FROM h
      UNION SELECT database, sid, id1, id2, 'waits' FROM l WHERE request > 0)
    SELECT * FROM e WHERE (database, id1, id2) IN (SELECT (database, id1, id2) FROM e GROUP BY database, id1, id2 HAVING count(DISTINCT edge) = 2)""",
)
def k02_edges(t):
    return lk.lock_edges(locks(t), sessions(t), DB)


@query(
    "k03_holder_detail",
    f"""WITH {BASE_SQL} SELECT DISTINCT s.database, s.sid, serial, username, program || '.exe' AS program,
      coalesce(CAST(s.sql_id AS VARCHAR), prev_sql_id || '(prev)') AS sql_id, spid, sql_text
    FROM s JOIN p ON paddr = addr AND p.database = s.database
      LEFT JOIN q ON q.sql_id = coalesce(s.sql_id, prev_sql_id) AND q.database = s.database
    WHERE type <> 'BACKGROUND' AND (s.database, s.sid) IN (SELECT (a.database, a.sid) FROM l a JOIN l b
      ON a.database = b.database AND a.id1 = b.id1 AND a.id2 = b.id2
      WHERE a.block = 1 AND b.request > 0)""",
)
def k03_holder(t):
    return lk.lock_session_detail(locks(t), sessions(t), procs(t), statements(t), "holder", DB)


@query(
    "k03_waiter_detail",
    f"""WITH {BASE_SQL} SELECT DISTINCT s.database, s.sid, serial, username, program || '.exe' AS program, s.sql_id, sql_text
    FROM s LEFT JOIN q ON q.sql_id = s.sql_id AND q.database = s.database WHERE type <> 'BACKGROUND'
      AND (s.database, s.sid) IN (SELECT (a.database, a.sid) FROM l a JOIN l b
      ON a.database = b.database AND a.id1 = b.id1 AND a.id2 = b.id2 WHERE a.block = 0 AND b.request > 0)""",
)
def k03_waiter(t):
    return lk.lock_session_detail(locks(t), sessions(t), procs(t), statements(t), "waiter", DB)


@query(
    "k04_wait_tier",
    f"""WITH {BASE_SQL}, {HOLD_SQL}, m AS (SELECT l.database, id1, max(last_call_et / 60.0::DOUBLE) AS max_minutes
      FROM l JOIN s ON s.sid = l.sid AND s.database = l.database
      WHERE request > 0 AND (l.database, id1, id2) IN (SELECT (database, id1, id2) FROM h) GROUP BY l.database, id1)
    SELECT *, CASE WHEN max_minutes > 120 THEN 120 WHEN max_minutes > 60 THEN 60 WHEN max_minutes > 30 THEN 30 ELSE 0 END AS tier
    FROM m""",
)
def k04(t):
    return lk.wait_tier(lk.blocked_waiters(locks(t), sessions(t), DB), [DB, "id1"])


@query(
    "k05_blocker_list",
    f"""WITH {BASE_SQL} SELECT DISTINCT database, id1, sid FROM l WHERE block = 1""",
)
def k05(t):
    return lk.blocker_list(locks(t), [DB, "id1"])


@query(
    "k06_session_list",
    f"""WITH {BASE_SQL} SELECT DISTINCT s.database, s.sid, {text_sql('')} FROM s JOIN p ON paddr = addr AND p.database = s.database
    WHERE username IS NOT NULL AND type <> 'BACKGROUND'""",
)
def k06(t):
    return lk.session_list(sessions(t), procs(t), DB)


@query(
    "k07_session_sql",
    f"""WITH {BASE_SQL} SELECT DISTINCT s.database, s.sid, serial, username, program || '.exe' AS program,
      coalesce(CAST(s.sql_id AS VARCHAR), prev_sql_id || '(prev)') AS sql_id, spid, sql_text
    FROM s JOIN p ON paddr = addr AND p.database = s.database
      LEFT JOIN q ON q.sql_id = coalesce(s.sql_id, prev_sql_id) AND q.database = s.database WHERE type <> 'BACKGROUND'""",
)
def k07(t):
    return lk.session_sql(sessions(t), procs(t), statements(t), DB)


@query(
    "k08_wrapped_text",
    r"SELECT doc_id, regexp_replace(text, '(.{120})', '\1' || chr(10), 'g') AS wrapped FROM documents",
)
def k08(t):
    return t.documents.select("doc_id", lk.wrapped("text").alias("wrapped"))


def busy_locks(t):
    """Users as sessions that hold and wait for several resources, so that chains and cycles arise."""
    kind = F.col("event_type")
    return t.events.select(
        database(),
        F.col("user_id").alias("sid"),
        F.floor(F.col("value")).cast("long").alias("id1"),
        (F.dayofmonth("ts") % 2).alias("id2"),
        F.when(kind == "error", 1).otherwise(0).alias("block"),
        F.when(kind == "click", 6).otherwise(0).alias("request"),
    )


def busy_sessions(t):
    rows = t.events.groupBy(database(), F.col("user_id").alias("sid")).agg(F.min("ts").alias("logon_time"))
    return rows.withColumn("type", F.when(F.col("sid") % 10 == 0, "BACKGROUND").otherwise("USER"))


# Walks up from every waiter; a walk longer than there are waiters has met a cycle.
@query(
    "k09_wait_chains",
    """WITH RECURSIVE s AS (SELECT user_id AS sid, 'DB' || user_id % 3 AS database, min(ts) AS since FROM events GROUP BY ALL),
    k AS (SELECT DISTINCT 'DB' || user_id % 3 AS database, user_id AS sid, CAST(floor(value) AS BIGINT) AS id1, day(ts) % 2 AS id2, event_type FROM events),
    w AS (SELECT a.database, a.sid AS waiter_sid, b.sid AS blocker_sid, a.id1, a.id2 FROM k a
      JOIN k b ON b.database = a.database AND b.id1 = a.id1 AND b.id2 = a.id2 AND b.sid <> a.sid
      JOIN s ON s.database = b.database AND s.sid = b.sid
      WHERE a.event_type = 'click' AND b.event_type = 'error' AND b.sid % 10 <> 0
      QUALIFY row_number() OVER (PARTITION BY a.database, a.sid ORDER BY s.since, b.sid, a.id1, a.id2) = 1),
    r AS (SELECT database, waiter_sid, blocker_sid AS up, 1::BIGINT AS depth FROM w
      UNION ALL SELECT r.database, r.waiter_sid, w.blocker_sid, r.depth + 1 FROM r
        JOIN w ON w.database = r.database AND w.waiter_sid = r.up WHERE r.depth <= (SELECT max(n) FROM (SELECT count(*) AS n FROM w GROUP BY database))),
    e AS (SELECT r.* FROM r LEFT JOIN w ON w.database = r.database AND w.waiter_sid = r.up WHERE w.waiter_sid IS NULL),
    c AS (SELECT DISTINCT database, waiter_sid FROM r WHERE up = waiter_sid)
    SELECT w.database, w.waiter_sid, w.blocker_sid, w.id1, w.id2, e.up AS root_sid, e.depth, c.waiter_sid IS NOT NULL AS deadlock
    FROM w LEFT JOIN e ON e.database = w.database AND e.waiter_sid = w.waiter_sid
      LEFT JOIN c ON c.database = w.database AND c.waiter_sid = w.waiter_sid""",
)
def k09(t):
    return lk.wait_chains(busy_locks(t), busy_sessions(t), DB)
