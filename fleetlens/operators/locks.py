"""Lock waits and session reports.

A resource can have many holders and many waiters, so holder-waiter pairs are
never formed. Each waiter is shown with its resource's first holder and the
number of holders, and the full graph is given by holder -> resource -> waiter
edges, which has the same reachability and grows only with the lock table.

Session, process and resource numbers repeat in every database. ``by`` names the
columns that tell databases apart; they are part of every join and grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import cat, columns, short_host
from fleetlens.sinks.tables import settled

RESOURCE = ["id1", "id2"]


def foreground(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("type") != "BACKGROUND")


def minutes_waiting() -> Column:
    return F.col("last_call_et") / F.lit(60.0)


def described(prefix: str, with_process: bool = True) -> Column:
    """One line naming the session, its host, program and idle time."""
    process = cat(" SERIAL#=", F.col("serial").cast("string"), " [OSPID:", F.col("spid").cast("string"), "]")
    return cat(
        prefix,
        F.col("username"),
        " (",
        F.col("osuser"),
        ") on ",
        short_host("machine"),
        " (SID=",
        F.col("sid").cast("string"),
        process if with_process else "",
        ") using: ",
        short_host("program"),
        " since ",
        F.date_format("logon_time", "dd MMM yyyy HH:mm:ss"),
        " (last call: ",
        F.round(minutes_waiting()).cast("long").cast("string"),
        " mins ago)",
    )


def blockers(locks: DataFrame, sessions: DataFrame, procs: DataFrame, by=()) -> DataFrame:
    """Sessions that hold a blocking lock, described."""
    by = columns(by)
    holding = locks.filter(F.col("block") == 1).select(*by, "sid").distinct()
    return (
        foreground(sessions)
        .join(holding, [*by, "sid"], "left_semi")
        .join(_processes(procs, by), [*by, "paddr"])
        .select(*by, "sid", described("-- BLOCKER => ").alias("description"), minutes_waiting().alias("minutes"))
        .distinct()
    )


def _processes(procs: DataFrame, by: list[str]) -> DataFrame:
    return procs.select(*by, F.col("addr").alias("paddr"), "spid")


def blocked_waiters(locks: DataFrame, sessions: DataFrame, by=()) -> DataFrame:
    """One row per waiting request: its first holder, the holder count and minutes waiting."""
    by = columns(by)
    # Holders and waiters of a resource are told apart by a mark and gathered in one grouping.
    rows = _marked(locks, by).join(sessions, [*by, "sid"])
    holds = F.col("holds") & (F.col("type") != "BACKGROUND")
    per_resource = (
        rows.filter(holds)
        .groupBy(*by, *RESOURCE)
        .agg(F.min_by("sid", F.struct("logon_time", "sid")).alias("holder_sid"), F.count_distinct("sid").alias("holders"))
    )
    return (
        rows.filter(F.col("waits"))
        .join(per_resource, [*by, *RESOURCE])
        .select(
            *by,
            "holder_sid",
            "holders",
            F.col("sid").alias("waiter_sid"),
            *RESOURCE,
            described("---- BLOCKED => ", with_process=False).alias("description"),
            minutes_waiting().alias("blocked_mins"),
        )
    )


def _marked(locks: DataFrame, by: list[str]) -> DataFrame:
    """One row per session and resource: whether it holds or waits."""
    holds, waits = F.coalesce(F.col("block") == 1, F.lit(False)), F.coalesce(F.col("request") > 0, F.lit(False))
    rows = locks.filter(holds | waits).groupBy(*by, "sid", *RESOURCE)
    return rows.agg(F.bool_or(holds).alias("holds"), F.bool_or(waits).alias("waits"))


def lock_edges(locks: DataFrame, sessions: DataFrame, by=()) -> DataFrame:
    """The wait graph as session -> resource (holds) and resource -> session (waits) edges.

    Only resources with both a holder and a waiter appear.
    """
    by = columns(by)
    rows = _marked(locks, by).join(sessions.select(*by, "sid", "type"), [*by, "sid"])
    rows = rows.withColumn("holds", F.col("holds") & (F.col("type") != "BACKGROUND")).filter(F.col("holds") | F.col("waits"))
    resource = [*by, *RESOURCE]
    contested = rows.groupBy(*resource).agg(F.bool_or("holds").alias("h"), F.bool_or("waits").alias("w")).filter("h AND w")
    kinds = F.array_compact(F.array(F.when(F.col("holds"), F.lit("holds")), F.when(F.col("waits"), F.lit("waits"))))
    return rows.join(contested.select(*resource), resource, "left_semi").select(*by, "sid", *RESOURCE, F.explode(kinds).alias("edge"))


def wait_for(locks: DataFrame, sessions: DataFrame, by=()) -> DataFrame:
    """One row per waiting session: the session it waits for, and on which resource.

    Of a resource's holders that is the first to log on that is not the waiter itself; of several
    resources a session waits for, the one whose holder logged on first.
    """
    by = columns(by)
    resource = [*by, *RESOURCE]
    rows = _marked(locks, by).join(sessions.select(*by, "sid", "type", "logon_time"), [*by, "sid"])
    first = Window.partitionBy(*resource).orderBy("logon_time", "sid")
    # Two holders are enough: if the first is the waiter, it is the second that blocks.
    holders = rows.filter(F.col("holds") & (F.col("type") != "BACKGROUND")).withColumn("_rn", F.row_number().over(first)).filter("_rn <= 2")
    holders = holders.select(*resource, F.col("sid").alias("blocker_sid"), F.col("logon_time").alias("_since"))
    met = rows.filter("waits").select(*resource, "sid").join(holders, resource).filter("blocker_sid <> sid")
    best = F.min(F.struct("_since", "blocker_sid", *RESOURCE)).alias("_b")
    return met.groupBy(*by, "sid").agg(best).select(*by, F.col("sid").alias("waiter_sid"), "_b.blocker_sid", *[f"_b.{c}" for c in RESOURCE])


def wait_chains(locks: DataFrame, sessions: DataFrame, by=()) -> DataFrame:
    """Each waiter with the root of its chain, its distance from there, and whether it is part of a deadlock.

    Who waits for whom is followed in steps that double in length, so a chain of a thousand takes
    ten rounds. Chains without end lead into a cycle: they have no root and no depth, and those
    sessions are deadlocked that lie on the cycle itself.
    """
    by = columns(by)
    edges = settled(wait_for(locks, sessions, by), "waits")
    waiters, reach = edges.count(), 1
    steps = edges.select(*by, "waiter_sid", F.col("blocker_sid").alias("up"), F.lit(1).cast("long").alias("depth"))
    endless = steps.limit(0)
    while True:
        above = steps.select(*by, F.col("waiter_sid").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_depth"))
        met = steps.join(above, [*by, "up"], "left")
        steps = settled(
            met.select(
                *by, "waiter_sid", F.coalesce("_up", "up").alias("up"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
                F.col("_up").isNotNull().alias("moved"),
            ),
            "wait-steps",
        )
        reach *= 2
        moved, steps = steps.filter("moved"), steps.drop("moved")
        if moved.isEmpty():
            break
        if reach > 2 * waiters:
            endless = moved.drop("moved")
            break
    # So many steps lead past any way into a cycle, and from the cycle's sessions to all of them.
    on_cycle = endless.select(*by, F.col("up").alias("waiter_sid")).distinct().withColumn("_on", F.lit(True))
    lost = endless.select(*by, "waiter_sid").withColumn("_lost", F.lit(True))
    out = edges.join(steps, [*by, "waiter_sid"]).join(lost, [*by, "waiter_sid"], "left").join(on_cycle, [*by, "waiter_sid"], "left")
    ends = F.col("_lost").isNull()
    return out.select(
        *by,
        "waiter_sid",
        "blocker_sid",
        *RESOURCE,
        F.when(ends, F.col("up")).alias("root_sid"),
        F.when(ends, F.col("depth")).alias("depth"),
        F.col("_on").isNotNull().alias("deadlock"),
    )


def wrapped(text: str, width: int = 120) -> Column:
    """A line break after every ``width`` characters."""
    return F.regexp_replace(text, "(.{%d})" % width, "$1\n")


def lock_session_detail(
    locks: DataFrame, sessions: DataFrame, procs: DataFrame, statements: DataFrame, role: str = "holder", by=()
) -> DataFrame:
    """Holders or waiters on contested resources, with their statement text.

    A holder without a current statement shows its previous one, marked.
    """
    by = columns(by)
    contested = locks.filter(F.col("request") > 0).select(*by, *RESOURCE).distinct()
    flag = 1 if role == "holder" else 0
    wanted = locks.filter(F.col("block") == flag).join(contested, [*by, *RESOURCE], "left_semi").select(*by, "sid").distinct()
    chosen = foreground(sessions).join(wanted, [*by, "sid"], "left_semi")
    if role == "holder":
        return _with_statement(chosen, procs, statements, by)
    return (
        chosen.join(statements.select(*by, "sql_id", "sql_text"), [*by, "sql_id"], "left")
        .select(*by, "sid", "serial", "username", "program", "sql_id", wrapped("sql_text").alias("sql_text"))
        .distinct()
    )


def _with_statement(sessions: DataFrame, procs: DataFrame, statements: DataFrame, by: list[str]) -> DataFrame:
    shown = F.when(F.col("sql_id").isNull(), cat(F.col("prev_sql_id").cast("string"), "(prev)")).otherwise(
        F.col("sql_id").cast("string")
    )
    text = statements.select(*by, F.col("sql_id").alias("_used"), "sql_text")
    return (
        sessions.join(_processes(procs, by), [*by, "paddr"])
        .withColumn("_used", F.coalesce("sql_id", "prev_sql_id"))
        .join(text, [*by, "_used"], "left")
        .select(*by, "sid", "serial", "username", "program", shown.alias("sql_id"), "spid", wrapped("sql_text").alias("sql_text"))
        .distinct()
    )


def wait_tier(waiters: DataFrame, by=()) -> DataFrame:
    """Longest wait and its tier: over 30, 60 or 120 minutes."""
    longest = waiters.groupBy(*columns(by)).agg(F.max("blocked_mins").alias("max_minutes"))
    m = F.col("max_minutes")
    return longest.withColumn("tier", F.when(m > 120, 120).when(m > 60, 60).when(m > 30, 30).otherwise(0))


def blocker_list(locks: DataFrame, by) -> DataFrame:
    """Blocking sessions of each ``by``."""
    return locks.filter(F.col("block") == 1).select(*columns(by), "sid").distinct()


def session_list(sessions: DataFrame, procs: DataFrame, by=()) -> DataFrame:
    """Described foreground sessions of named users."""
    by = columns(by)
    return (
        foreground(sessions)
        .filter(F.col("username").isNotNull())
        .join(_processes(procs, by), [*by, "paddr"])
        .select(*by, "sid", described("").alias("description"))
        .distinct()
    )


def session_sql(sessions: DataFrame, procs: DataFrame, statements: DataFrame, by=()) -> DataFrame:
    """Current, else previous, statement of each foreground session that has one."""
    known = foreground(sessions).filter(F.col("sql_id").isNotNull() | F.col("prev_sql_id").isNotNull())
    return _with_statement(known, procs, statements, columns(by))
