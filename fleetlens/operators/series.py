"""Metric and event series: panels, averages, deltas, bursts and gaps."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import (
    Band,
    columns,
    earliest,
    hour_start,
    instant,
    left_join_null_safe,
    mean_if,
    midnight,
    ntz,
    scientific,
    seconds_between,
)
from fleetlens.operators.latest import newest_first
from fleetlens.operators.series_order import with_previous


# Idle events, the group each wait event counts towards, and the statistics kept.
IDLE_EVENTS = (
    "SQL*Net message from client",
    "SQL*Net more data from client",
    "pmon timer",
    "rdbms ipc message",
    "rdbms ipc reply",
    "smon timer",
)
WAIT_GROUPS = {
    "WAIT: SINGLE BLOCK READ": ["db file sequential read"],
    "WAIT: SQLNET WAITS": [
        "SQL*Net message to client",
        "SQL*Net message to dblink",
        "SQL*Net more data to client",
        "SQL*Net more data to dblink",
        "SQL*Net break/reset to client",
        "SQL*Net break/reset to dblink",
    ],
    "WAIT: MULTIBLOCK READ": ["db file scattered read"],
    "WAIT: LOGWRITE": ["log file single write", "log file parallel write"],
    "WAIT: IO WAITS": ["file identify", "file open"],
    "WAIT: CONTROLFILE IO": [
        "control file sequential read",
        "control file single write",
        "control file parallel write",
    ],
    "WAIT: DIRECTPATH READ": ["direct path read"],
}
OTHER_WAITS = "WAIT: OTHER WAITS"
# Statistics that count reads from disk, and blocks got from the buffer.
BUFFER_READS = ("physical reads",)
BUFFER_GETS = ("db block gets", "consistent gets")
KEPT_STATISTICS = (
    "db block gets",
    "consistent gets",
    "physical reads",
    "physical reads direct",
    "physical writes direct",
    "table scans (direct read)",
    "table scans (long tables)",
    "table scans (rowid ranges)",
    "table scans (short tables)",
    "db_block_changes",
    "redo writes",
)


def wait_mapping(spark: SparkSession) -> DataFrame:
    """The wait groups as a mapping table for :func:`collect_metrics`."""
    rows = [(event, metric) for metric, events in WAIT_GROUPS.items() for event in events]
    return spark.createDataFrame(rows, "event string, metric string")


def collect_metrics(
    events: DataFrame,
    mapping: DataFrame,
    *,
    by=(),
    event: str = "event",
    value: str = "total_waits",
    exclude: Sequence[str] = (),
    other: str | None = None,
    zeros: bool = False,
) -> DataFrame:
    """Wide counters to long ``(metric, value)`` rows.

    ``mapping`` has ``event`` and ``metric``; events without a mapping go to the
    metric named ``other`` when given. ``exclude`` lists events to ignore. With
    ``zeros`` a metric without events is reported as 0 for every group.
    """
    by = columns(by)
    rows = events.filter(~F.col(event).isin(list(exclude))) if exclude else events
    # Counters are summed per event before the map is joined, so the join sees one row per event.
    sums = rows.groupBy(*by, F.col(event).alias("event")).agg(F.sum(value).alias("value"))
    named = sums.join(mapping.select("event", "metric"), "event", "left")
    metric = F.coalesce("metric", F.lit(other)) if other is not None else F.col("metric")
    found = named.select(*by, metric.alias("metric"), "value").filter(F.col("metric").isNotNull())
    if zeros:
        # The metric names are a short list; they travel as one array beside each group.
        extra = F.array(*[F.lit(m) for m in ([other] if other is not None else [])]).cast("array<string>")
        names = mapping.agg(F.array_union(F.collect_set("metric"), extra).alias("names"))
        if by:
            every = sums.select(*by).distinct().select(*by, F.explode(names.scalar()).alias("metric"))
        else:
            every = names.select(F.explode("names").alias("metric"))
        found = found.unionByName(every.withColumn("value", F.lit(0).cast(sums.schema["value"].dataType)))
    return found.groupBy(*by, "metric").agg(F.sum("value").alias("value"))


def metric_snapshot(
    waits: DataFrame,
    sessions: DataFrame,
    license: DataFrame,
    stats: DataFrame,
    pga: DataFrame,
    sga: DataFrame,
    by: str,
    *,
    mapping: DataFrame | None = None,
    other: str = OTHER_WAITS,
    exclude: Sequence[str] = IDLE_EVENTS,
    statistics: Sequence[str] = KEPT_STATISTICS,
    reads: Sequence[str] = BUFFER_READS,
    gets: Sequence[str] = BUFFER_GETS,
) -> DataFrame:
    """All metrics of a snapshot as ``(by, metric, value)``: waits, sessions, statistics, hit ratio and memory.

    The hit ratio is left out where nothing was got from the buffer.
    """
    gig = 1024.0**3

    def row(df: DataFrame, metric: Column, value: Column) -> DataFrame:
        return df.select(by, metric.alias("metric"), value.cast("double").alias("value"))

    mapping = wait_mapping(waits.sparkSession) if mapping is None else mapping
    groups = collect_metrics(waits, mapping, by=by, exclude=exclude, other=other, zeros=True)
    current = sessions.groupBy(by).agg(F.count("username").alias("n"))
    got, read = (F.sum(F.when(F.col("name").isin(*names), F.col("value")).otherwise(0)).cast("double") for names in (gets, reads))
    hits = stats.groupBy(by).agg((F.lit(1.0) - F.try_divide(read, got)).alias("ratio"))
    shared = sga.groupBy(by).agg(F.sum("bytes").alias("bytes"))
    parts = [
        row(groups, F.col("metric"), F.col("value")),
        row(license, F.lit("SESSIONS: HIGHWATER"), F.col("sessions_highwater")),
        row(current, F.lit("SESSIONS: CURRENT"), F.col("n")),
        row(
            stats.filter(F.col("name").isin(*statistics)),
            F.concat(F.lit("STAT: "), F.upper("name")),
            F.col("value"),
        ),
        row(hits.filter(F.col("ratio").isNotNull()), F.lit("STAT: BUFFER HIT RATIO"), F.col("ratio")),
        row(
            pga.filter(F.col("name") == "total PGA allocated"),
            F.lit("MEMORY: PGA"),
            F.round(F.col("value") / gig, 3),
        ),
        row(shared, F.lit("MEMORY: SGA"), F.round(F.col("bytes") / gig, 3)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def ratio_metric(
    stats: DataFrame, name: str, value: str, numerator: Sequence[str], denominator: Sequence[str], by=()
) -> DataFrame:
    """1 - sum(numerator) / sum(denominator) per group; null for an empty denominator."""

    def total(names: Sequence[str]) -> Column:
        return F.sum(F.when(F.col(name).isin(list(names)), F.col(value))).cast("double")

    out = (F.lit(1.0) - F.try_divide(total(numerator), total(denominator))).alias("ratio")
    by = columns(by)
    return stats.groupBy(*by).agg(out) if by else stats.agg(out)


def lag_panel(
    df: DataFrame, keys, ts: str, value: str, offsets: Sequence[int] = (1, 2, 3, 6, 9, 12), tie_break: Sequence[str] = ()
) -> DataFrame:
    """Newest row per series with the values k samples earlier.

    Only the newest ``max(offsets) + 1`` rows per series are ever shuffled; the
    lags are positions in that short tail.
    """
    keys = columns(keys)
    depth = max(offsets) + 1
    window = Window.partitionBy(*keys).orderBy(*newest_first(ts, value, *tie_break))
    rows = df.select(*keys, ts, value, *[c for c in tie_break if c not in (ts, value)])
    # The filter is on the bare row number: that is what lets Spark limit groups before the shuffle.
    tail = rows.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= depth)

    def at(c: str, k: int) -> Column:
        return F.max(F.when(F.col("_rank") == k + 1, F.col(c)))

    return tail.groupBy(*keys).agg(
        at(ts, 0).alias(ts), at(value, 0).alias("now_value"), *[at(value, k).alias(f"back_{k}") for k in offsets]
    )


def metric_bands(as_of, unit: timedelta = timedelta(hours=1)) -> list[Band]:
    """Average bands: now, quarter, one, two and six units, today, and the two days before.

    With the default unit these are the last 6 and 15 minutes, 1, 2 and 6 hours.
    """
    now = instant(as_of)
    ahead = now + unit
    return [
        Band("now", now - unit / 10, None, lo_closed=False),
        Band("quarter", now - unit / 4, None, lo_closed=False),
        Band("one", now - unit, ahead),
        Band("two", now - 2 * unit, ahead),
        Band("six", now - 6 * unit, ahead),
        Band("today", midnight(as_of), None, lo_closed=False),
        Band("yesterday", midnight(as_of, -2), midnight(as_of), lo_closed=False),
    ]


def window_averages(df: DataFrame, keys, ts: str, value: str, bands: Sequence[Band], anchor: str = "today") -> DataFrame:
    """Average per band and series in one scan; series without a value in the anchor band drop out."""
    keys = columns(keys)
    since = earliest(bands)
    rows = df if since is None else df.filter(F.col(ts) >= ntz(since))
    anchor_band = next(b for b in bands if b.name == anchor)
    return (
        rows.groupBy(*keys)
        .agg(
            *[mean_if(value, b.contains(ts)).alias(f"{b.name}_avg") for b in bands],
            F.count_if(anchor_band.contains(ts) & F.col(value).isNotNull()).alias("_anchored"),
        )
        .filter(F.col("_anchored") > 0)
        .drop("_anchored")
    )


def metric_panel(
    df: DataFrame,
    keys,
    ts: str,
    value: str,
    as_of,
    *,
    bands: Sequence[Band] | None = None,
    seen_within: timedelta = timedelta(hours=1),
    offsets: Sequence[int] = (1, 2, 3, 6, 9, 12),
    anchor: str = "today",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Lag panel and averages side by side for series seen within ``seen_within`` of ``as_of``."""
    keys = columns(keys)
    # Only series seen lately are ranked; they are found in a scan that reads no older rows.
    lately = df.filter(F.col(ts) > ntz(instant(as_of) - seen_within)).select(*keys).distinct()
    panel = lag_panel(df.join(lately, keys, "left_semi"), keys, ts, value, offsets, tie_break)
    fresh = panel.filter(F.col(ts) > ntz(instant(as_of) - seen_within))
    averages = window_averages(df, keys, ts, value, bands or metric_bands(as_of), anchor)
    return fresh.join(averages, keys)


def counter_deltas(
    df: DataFrame,
    keys,
    order: Sequence[str],
    count: str,
    time: str,
    *,
    ranges: int | None = None,
) -> DataFrame:
    """Difference from the previous snapshot; counter resets are skipped."""
    pairs = with_previous(df, keys, order, [count, time], ranges=ranges)
    waits = F.col(count) - F.col(f"prev_{count}")
    waited = F.col(time) - F.col(f"prev_{time}")
    return (
        pairs.withColumn("snap_waits", waits)
        .withColumn("snap_waited", waited)
        .filter(F.col("snap_waits") >= 0)
        .withColumn("wait_average", F.try_divide(F.col("snap_waited").cast("double"), F.col("snap_waits").cast("double")))
        .drop(f"prev_{count}", f"prev_{time}")
    )


def hour_of_day_matrix(df: DataFrame, ts: str, as_of, days: int = 8, by=()) -> DataFrame:
    """Day by hour counts for the days that start within ``days`` of ``as_of``."""
    since = instant(as_of) - timedelta(days=days)
    # A day counts when its own midnight is later than ``since``.
    rows = df.filter(F.col(ts) >= ntz(midnight(since, 1)))
    hour = F.hour(ts)
    return rows.groupBy(*columns(by), F.to_date(ts).alias("day")).agg(
        *[F.count_if(hour == h).alias(f"h{h:02d}") for h in range(24)]
    )


def burst_check(df: DataFrame, keys, ts: str, limit: int = 60) -> DataFrame:
    """Hours with more than ``limit`` events of one key."""
    return (
        df.groupBy(*columns(keys), hour_start(ts).alias("hour"))
        .agg(F.count("*").alias("events"))
        .filter(F.col("events") > limit)
    )


def gap_check(
    df: DataFrame,
    partition,
    order: Sequence[str],
    ts: str,
    *,
    since,
    target_s: float | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Longest gap in seconds between consecutive events of one thread that end after ``since``.

    Without a target the limit is one switch a day. Events up to ``since`` are not sorted: of
    them only those count that follow a thread's first late event in order, and the one before it.
    """
    limit = 86400.0 if not target_s else float(target_s)
    kind = "ARCHIVE_LOG_TARGET" if target_s else "1 DAY"
    keys = columns(partition)
    rows = _around(df.select(*keys, *[c for c in dict.fromkeys([*order, ts]) if c not in keys]), keys, order, ts, since)
    pairs = with_previous(rows, keys, order, [ts], ranges=ranges)
    gaps = pairs.filter((F.col(ts) > ntz(since)) & F.col(f"prev_{ts}").isNotNull())
    return (
        gaps.groupBy(*keys)
        .agg(F.round(F.max(seconds_between(F.col(ts), F.col(f"prev_{ts}"))), 2).alias("gap_seconds"))
        .withColumn("target", F.lit(limit))
        .withColumn("target_type", F.lit(kind))
        .withColumn("status", F.when(F.col("gap_seconds") > limit, "ERROR").otherwise("OK"))
    )


def _around(rows: DataFrame, keys: list[str], order: Sequence[str], ts: str, since) -> DataFrame:
    """The rows after ``since``, and the earlier ones that a predecessor of theirs can be."""
    late = rows.filter(F.col(ts) > ntz(since))
    place, everything = F.struct(*order), F.struct(*[F.col(c) for c in rows.columns])
    firsts = late.groupBy(*keys).agg(F.min(place).alias("_first"))
    early = rows.filter((F.col(ts) <= ntz(since)) | F.col(ts).isNull())
    early = left_join_null_safe(early, firsts, keys).filter(F.col("_first").isNotNull())
    between = early.filter(place >= F.col("_first")).drop("_first")
    last = early.filter(place < F.col("_first")).groupBy(*keys).agg(F.max_by(everything, place).alias("_row")).select("_row.*")
    return late.unionByName(between).unionByName(last)


def panel_text(panel: DataFrame, figures: Sequence[str]) -> DataFrame:
    """The figures of a panel in scientific notation, 'N/A' where missing."""
    return panel.select(
        *[F.coalesce(scientific(c), F.lit("N/A")).alias(c) if c in figures else F.col(c) for c in panel.columns]
    )


def log_switch_verdict(
    df: DataFrame, partition, order: Sequence[str], ts: str, *, since, limit: int = 60, target_s: float | None = None
) -> DataFrame:
    """Per thread: WARNING after a burst, else ERROR after too long a gap, else OK."""
    keys = columns(partition)
    bursts = burst_check(df, keys, ts, limit).select(*keys).distinct().withColumn("_burst", F.lit(True))
    gaps = gap_check(df, keys, order, ts, since=since, target_s=target_s).drop("status")
    verdict = F.when(F.col("_burst"), "WARNING").when(F.col("gap_seconds") > F.col("target"), "ERROR").otherwise("OK")
    return gaps.join(bursts, keys, "full_outer").withColumn("verdict", verdict).drop("_burst")


def peak_daily_volume(events: DataFrame, sizes: DataFrame, ts: str, size: str, by=()) -> DataFrame:
    """Largest daily event count times the mean file size, in rounded megabytes; per ``by`` where given."""
    by = columns(by)
    daily = events.groupBy(*by, F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    most = daily.groupBy(*by).agg(F.max("n").alias("n"))
    mean = sizes.groupBy(*by).agg(F.try_divide(F.sum(size).cast("double"), F.count(size).cast("double")).alias("mean"))
    both = most.join(mean, by) if by else most.withColumn("mean", mean.scalar())
    return both.select(*by, F.round(F.col("n") * F.col("mean") / 1024 / 1024).alias("peak_mb"))


def sample_rollup(df: DataFrame, keys, ts: str, value: str) -> DataFrame:
    """Hourly count, mean, minimum and maximum per series: the compact form of old history."""
    return df.groupBy(*columns(keys), hour_start(ts).alias("hour")).agg(
        F.count(value).alias("samples"),
        F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double")).alias("mean_value"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
    )

