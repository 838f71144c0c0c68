"""Capacity: band comparison, growth ladders, containers and directories."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import (
    Band,
    cat,
    columns,
    directory_of,
    earliest,
    epoch_micros,
    flagged,
    instant,
    micros_between,
    midnight,
    not_disabled,
    ntz,
    one_or_struct,
    percent,
)

MEG = 1024.0 * 1024.0


def capacity_bands(as_of) -> list[Band]:
    """Today, the week before, the week before that, and back to 62 days.

    The midnights 7 and 13 days back belong to two bands each.
    """
    return [
        Band("now", midnight(as_of), None),
        Band("yesterday", midnight(as_of, -7), midnight(as_of)),
        Band("lastweek", midnight(as_of, -13), midnight(as_of, -7), hi_closed=True),
        Band("lastmonth", midnight(as_of, -62), midnight(as_of, -13), hi_closed=True),
    ]


def band_compare(
    df: DataFrame,
    keys,
    ts: str,
    pct: str,
    as_of,
    *,
    how: str = "inner",
    tie_break: Sequence[str] = (),
    extra: Sequence[str] = (),
) -> DataFrame:
    """Latest value per key in each of the four bands, side by side, in one scan.

    One conditional ``max_by`` per band replaces four filtered scans and three
    joins. Missing older bands fall back month -> week -> yesterday -> 0.
    ``how='inner'`` keeps keys seen in every band; ``'left'`` keeps all keys seen
    today. ``extra`` columns are carried from today's row.
    """
    keys = columns(keys)
    bands = capacity_bands(as_of)
    order = one_or_struct(ts, *tie_break)
    used = F.coalesce(F.col(pct), F.lit(0))

    def pick(value: Column, band: Band, name: str) -> Column:
        return F.max_by(value, F.when(band.contains(ts), order)).alias(name)

    wide = (
        df.filter(F.col(ts) >= ntz(earliest(bands)))
        .groupBy(*keys)
        .agg(
            *[pick(used, b, f"_{b.name}") for b in bands],
            *[pick(F.col(c), bands[0], c) for c in extra],
        )
    )
    need = bands if how == "inner" else bands[:1]
    for band in need:
        wide = wide.filter(F.col(f"_{band.name}").isNotNull())
    now, day, week, month = (F.col(f"_{b.name}") for b in bands)
    day_base = F.coalesce(day, F.lit(0))
    week_base = F.coalesce(week, day_base)
    month_base = F.coalesce(month, week_base)
    return wide.select(
        *keys,
        *extra,
        now.alias("now_pct"),
        day.alias("yesterday_raw"),
        week.alias("lastweek_raw"),
        month.alias("lastmonth_raw"),
        day_base.alias("yesterday_pct"),
        week_base.alias("lastweek_pct"),
        month_base.alias("lastmonth_pct"),
        (now - day_base).alias("day_growth"),
        (now - week_base).alias("week_growth"),
        (now - month_base).alias("month_growth"),
        day.isNull().alias("no_yesterday"),
        week.isNull().alias("no_lastweek"),
        month.isNull().alias("no_lastmonth"),
    )


def growth_status(
    df: DataFrame,
    *,
    t_day: float = 80,
    t_week: float = 50,
    t_err: float = 95,
    t_crit: float = 98,
    weighting: float = 0,
    tiered: bool = False,
) -> DataFrame:
    """First matching rung of the growth ladder over :func:`band_compare` rows.

    A rung never fires on a missing band. ``weighting`` moves the thresholds by
    -w, +w, -w/2 and -w/4; ``tiered`` adds the severity to the text.
    """
    now, day, week = F.col("now_pct"), F.col("yesterday_raw"), F.col("lastweek_raw")
    left = F.lit(100) - now
    tag = (lambda text, tier: f"{text} ({tier})") if tiered else (lambda text, tier: text)
    ladder = (
        F.when((now > t_crit - weighting / 4) & (now > week), tag("Error: Weekly growth", "Brown"))
        .when((now > t_err - weighting / 2) & (now > week + 2), tag("Error: Weekly growth", "Red"))
        .when((now > t_week + weighting) & (left < now - week), tag("Error: Weekly growth", "Amber"))
        .when((now > t_day - weighting) & (left < now - day), tag("Error: Daily growth", "Amber"))
        .otherwise("OK")
    )
    return df.withColumn("status", ladder)


def growth_status_overrides(
    df: DataFrame,
    thresholds: DataFrame,
    on,
    *,
    used: str = "usedk",
    t_day: float = 80,
    t_week: float = 60,
    t_month: float = 50,
) -> DataFrame:
    """Growth ladder with per-entity overrides, projected-full and absolute-size rules.

    ``thresholds`` has ``error_pct_day/week/month`` and ``error_size_in_k`` per
    ``on`` key, each optional.
    """
    rows = df.join(thresholds, columns(on), "left")
    now, day = F.col("now_pct"), F.col("yesterday_raw")
    week, month = F.col("lastweek_raw"), F.col("lastmonth_raw")
    left = F.lit(100) - now

    def grown(base: Column, factor: int, limit: str, default: float) -> Column:
        over = now > F.coalesce(F.col(limit), F.lit(default))
        return (now > base) & (over | ((now - base) * factor >= left))

    status = (
        F.when(grown(day, 4, "error_pct_day", t_day), "*ERROR (day)*")
        .when(grown(week, 2, "error_pct_week", t_week) & (now > day), "*ERROR (wk)*")
        .when(grown(month, 1, "error_pct_month", t_month) & (now > day), "*ERROR (mth)*")
        .when(F.col(used) > F.col("error_size_in_k"), "*ERROR (size)*")
        .otherwise(" ")
    )
    return rows.withColumn("status", status)


def capacity_summary(df: DataFrame, keys, ts: str, pct: str, as_of, **thresholds) -> DataFrame:
    """Every entity seen today with its growth and status, older bands optional."""
    settings = {"t_day": 90, **thresholds}
    return growth_status(band_compare(df, keys, ts, pct, as_of, how="left"), **settings)


def expand_to_peers(databases: DataFrame, servers: DataFrame, name_pattern: str = "%") -> DataFrame:
    """Databases flagged for host checks on any physical host of a matching database.

    The hosts of matching databases are reduced to a distinct list first, so no
    pair of databases on a host is ever formed.
    """
    placed = databases.filter(not_disabled()).join(
        servers.select("server", F.col("physical_server_abbrev").alias("host")), "server"
    )
    hosts = placed.filter(F.col("database_name").like(name_pattern)).select("host").distinct()
    return (
        placed.filter(flagged("os_checks_ind"))
        .join(hosts, "host", "left_semi")
        .select("host", "database_name")
        .distinct()
    )


def recent_history(history: DataFrame, alerting: DataFrame, keys, ts: str, as_of, days: int = 14) -> DataFrame:
    """Detail rows of the flagged entities after midnight ``days`` ago."""
    recent = history.filter(F.col(ts) > ntz(midnight(as_of, -days)))
    return recent.join(alerting.select(*columns(keys)).distinct(), columns(keys), "left_semi")


def daily_high_water(df: DataFrame, keys, ts: str, value: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """First sample of each day that reached the day's maximum, per key."""
    keys = columns(keys)
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.col(value), F.lit(0) - epoch_micros(F.col(ts)), *tie_break))
    return (
        df.groupBy(*keys, F.to_date(ts).alias("day"))
        .agg(best.alias("best"))
        .select(*keys, "day", *[F.col("best")[c].alias(c) for c in rest])
    )


def growth_report(
    df: DataFrame,
    key: str,
    ts: str,
    value: str,
    as_of,
    *,
    horizons: dict[str, int] | None = None,
    how: str = "inner",
    tie_break: Sequence[str] = (),
) -> DataFrame:
    """Newest size against the earliest inside each horizon, in one aggregation.

    Absolute and percentage growth are null when the base is zero or missing.
    ``how='inner'`` keeps keys that have a row in every horizon.
    """
    horizons = horizons or {"month": 31, "six_month": 183, "year": 365}
    size = F.coalesce(F.col(value), F.lit(0))
    order = one_or_struct(ts, *tie_break)
    since = {name: instant(as_of) - timedelta(days=d) for name, d in horizons.items()}
    if how == "inner":
        # A series needs a sample in every horizon, so nothing before the longest one counts.
        df = df.filter(F.col(ts) > ntz(min(since.values())))
    wide = df.groupBy(key).agg(
        F.max(ts).alias("date_now"),
        F.max_by(size, order).alias("now_used"),
        *[F.min_by(size, F.when(F.col(ts) > ntz(t), order)).alias(f"{n}_used") for n, t in since.items()],
    )
    if how == "inner":
        for name in horizons:
            wide = wide.filter(F.col(f"{name}_used").isNotNull())
    out = [F.col(key), F.col("date_now"), F.col("now_used")]
    for name in horizons:
        base = F.col(f"{name}_used")
        usable = F.when(base != 0, base)
        out += [
            base,
            F.when(base != 0, F.col("now_used") - base).alias(f"{name}_growth"),
            (F.try_divide(F.col("now_used") - base, usable) * 100).alias(f"{name}_growth_pct"),
        ]
    return wide.select(*out)


# --- containers (tablespaces) ------------------------------------------------


def _containers(files: Sequence[DataFrame], free: DataFrame, kinds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums and kind per container that has a file, from one aggregation over all parts."""
    none = F.lit(None)
    parts = [f.select(*by, F.lit("file").alias("part"), "bytes", "maxbytes", none.alias("contents")) for f in files]
    parts.append(free.select(*by, F.lit("free").alias("part"), "bytes", none.alias("maxbytes"), none.alias("contents")))
    parts.append(kinds.select(*by, F.lit("kind").alias("part"), none.alias("bytes"), none.alias("maxbytes"), "contents"))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    is_file = F.col("part") == "file"
    largest = F.when(is_file & F.col("maxbytes").isNotNull() & F.col("bytes").isNotNull(), F.greatest("maxbytes", "bytes"))
    sums = rows.groupBy(*by).agg(
        (F.sum(F.when(is_file, F.col("bytes"))) / MEG).alias("total_mb"),
        (F.sum(largest) / MEG).alias("max_known_mb"),
        (F.sum(F.when(F.col("part") == "free", F.col("bytes"))) / MEG).alias("free_known_mb"),
        F.max("contents").alias("contents"),
        F.count_if(is_file).alias("files"),
    )
    return sums.filter("files > 0").drop("files")


def usage_bar(pct: Column) -> Column:
    """Twenty characters, one X per five percent."""
    marks = F.floor(F.round(pct, 2) / 5).cast("int")
    return (
        F.when(pct.isNull(), F.lit("[------OFFLINE-------]"))
        .otherwise(cat("[", F.rpad(F.repeat(F.lit("X"), marks), 20, "-"), "]"))
    )


def container_usage(
    files: Sequence[DataFrame],
    free: DataFrame,
    kinds: DataFrame,
    by=("container",),
    *,
    name_pattern: str = "%",
    min_pct: float | None = None,
) -> DataFrame:
    """Allocated, used, free, percentage and theoretical maximum per container.

    ``files`` lists the data and temporary file frames (``bytes``, ``maxbytes``); they, free
    space and kinds are summed up in one grouping. Empty and
    offline containers (no percentage) are listed; ``min_pct`` is the caller's filter.
    """
    by = columns(by)
    name = by[-1]
    rows = (
        _containers(files, free, kinds, by)
        .filter(F.col(name).like(name_pattern))
        .withColumn("free_mb", F.coalesce("free_known_mb", F.lit(0.0)))
        .withColumn("used_mb", F.col("total_mb") - F.col("free_mb"))
        .withColumn("max_mb", F.coalesce("max_known_mb", "total_mb"))
        .withColumn("pct_used", percent(F.col("used_mb"), F.col("total_mb")))
        .withColumn("pct_max_used", percent(F.col("used_mb"), F.col("max_mb")))
    )
    return (rows if min_pct is None else rows.filter(F.col("pct_used") > min_pct)).select(
        *by,
        kind_tag("contents").alias("kind"),
        "total_mb",
        "used_mb",
        "free_mb",
        "pct_used",
        "max_mb",
        "pct_max_used",
        usage_bar(F.col("pct_used")).alias("bar"),
        usage_bar(F.col("pct_max_used")).alias("max_bar"),
    )


def kind_tag(contents: str) -> Column:
    return F.when(F.col(contents) == "UNDO", " (u) ").when(F.col(contents) == "TEMPORARY", " (t) ").otherwise("")


def container_totals(usage: DataFrame) -> DataFrame:
    """Grand totals over the listed containers."""
    return usage.agg(*[F.sum(c).alias(f"grand_{c}") for c in ("total_mb", "used_mb", "free_mb")])


def container_alerts(
    usage: DataFrame, owner: str, name: str, *, pct: float = 89, exclude_kinds=(" (u) ", " (t) ")
) -> DataFrame:
    """One row per container above ``pct`` of its maximum; one row for an owner that has none."""
    high = F.round("pct_max_used").cast("long")
    over = F.coalesce(~F.col("kind").isin(*exclude_kinds) & (high > pct), F.lit(False))
    item = cat(F.col(name).cast("string"), "(", high.cast("string"), "%)")
    # Containers below the limit shrink to one row without an item before the window sees them.
    rows = usage.select(owner, F.when(over, item).alias("item")).distinct()
    some = F.count("item").over(Window.partitionBy(owner))
    who = F.col(owner).cast("string")
    quiet = cat("** No tablespace alerts for ", who, " **")
    loud = cat("** ERROR - tablespace alerts on ", who, ": ", F.col("item"), " **")
    return (
        rows.withColumn("some", some)
        .filter(F.col("item").isNotNull() | (F.col("some") == 0))
        .select(owner, "item", F.when(F.col("item").isNull(), quiet).otherwise(loud).alias("message"))
    )


def container_snapshot(usage: DataFrame, name: str, stamp, **constants) -> DataFrame:
    """Snapshot rows: container with its kind suffix, sizes, fixed labels and the time."""
    suffix = F.when(F.col("kind") == " (u) ", "(U)").when(F.col("kind") == " (t) ", "(T)").otherwise("")
    return usage.select(
        *[F.lit(v).alias(k) for k, v in constants.items()],
        cat(F.col(name).cast("string"), suffix).alias("container"),
        ntz(stamp).alias("space_time"),
        F.col("total_mb").alias("meg_data"),
        F.col("used_mb").alias("meg_used"),
        F.col("free_mb").alias("meg_free"),
    )


def total_size_snapshot(data: DataFrame, temp: DataFrame, free: DataFrame, by=()) -> DataFrame:
    """Data, temporary, free and used totals per host, in one aggregation over a tagged union."""
    by = columns(by)
    tagged = None
    for tag, part in (("data", data), ("temp", temp), ("free", free)):
        piece = part.select(*by, F.lit(tag).alias("part"), "bytes")
        tagged = piece if tagged is None else tagged.unionByName(piece)
    gig = 1024.0**3
    sums = tagged.groupBy(*by).agg(
        *[
            (F.coalesce(F.sum(F.when(F.col("part") == t, F.col("bytes"))), F.lit(0)) / gig).alias(f"gig_{t}")
            for t in ("data", "temp", "free")
        ]
    )
    return sums.withColumn("gig_used", F.col("gig_data") - F.col("gig_free"))


# --- files --------------------------------------------------------------------


def all_files(data: DataFrame, temp: DataFrame, members: DataFrame, groups: DataFrame, control: DataFrame, by=()) -> DataFrame:
    """Data, temporary, log-member and control files as ``(file_name, bytes)``.

    Group numbers and file names repeat in every database; ``by`` names the columns that tell them apart.
    """
    by = columns(by)
    logs = members.join(groups.select(*by, "group_no", "bytes"), [*by, "group_no"])
    logs = logs.select(*by, F.col("member").alias("file_name"), "bytes")
    controls = control.select(*by, "file_name", (F.col("block_size") * F.col("file_size_blocks")).alias("bytes"))
    named = [data.select(*by, "file_name", "bytes"), temp.select(*by, "file_name", "bytes"), logs, controls]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out


def size_by_directory(files: DataFrame, by=()) -> DataFrame:
    return files.groupBy(*columns(by), directory_of("file_name").alias("directory")).agg((F.sum("bytes") / MEG).alias("meg"))


def total_size(files: DataFrame, by=()) -> DataFrame:
    return files.groupBy(*columns(by)).agg((F.sum("bytes") / MEG).alias("meg"))


def size_by_prefix(files: DataFrame, length: int, by=()) -> DataFrame:
    return files.groupBy(*columns(by), F.substring("file_name", 1, length).alias("mountpoint")).agg(
        F.sum("bytes").alias("mount_size")
    )


def size_by_kind(databases: DataFrame, files: DataFrame, key: str = "database_id", page_kb: int = 8) -> DataFrame:
    """Row and log megabytes per database; databases without files stay, with nulls."""
    per_db = files.groupBy(key).agg(
        *[
            (F.sum(F.when(F.col("type") == t, F.col("size"))).cast("double") * page_kb / 1024).alias(n)
            for t, n in ((0, "row_size_mb"), (1, "log_size_mb"))
        ]
    )
    return databases.join(per_db, key, "left")


def resolve_threshold(entities: DataFrame, params: DataFrame, default: float = 95) -> DataFrame:
    """Most specific limit per entity: container, then database, then server, then default.

    ``params`` rows: ``param_name``, ``param_parent``, ``param_grand_parent``,
    ``param_value_num`` with the unused parents null.
    """
    name, parent, grand = F.col("param_name"), F.col("param_parent"), F.col("param_grand_parent")
    value = F.max("param_value_num")
    by_server = params.filter(parent.isNull() & grand.isNull()).groupBy(name.alias("server")).agg(value.alias("_s"))
    by_database = (
        params.filter(parent.isNotNull() & grand.isNull())
        .groupBy(name.alias("database_name"), parent.alias("server"))
        .agg(value.alias("_d"))
    )
    by_container = (
        params.filter(grand.isNotNull())
        .groupBy(name.alias("container"), parent.alias("database_name"), grand.alias("server"))
        .agg(value.alias("_c"))
    )
    return (
        entities.join(by_container, ["container", "database_name", "server"], "left")
        .join(by_database, ["database_name", "server"], "left")
        .join(by_server, ["server"], "left")
        .withColumn("threshold", F.coalesce("_c", "_d", "_s", F.lit(default)))
        .drop("_c", "_d", "_s")
    )


def staleness(df: DataFrame, ts: str, as_of, by=(), *, max_age_days: float = 1) -> DataFrame:
    """Age of the newest sample in rounded days; DISABLED without samples, WARNING when too old."""
    by = columns(by)
    newest = df.groupBy(*by).agg(F.max(ts).alias("newest"))
    age = F.round(micros_between(ntz(as_of), F.col("newest")) / F.lit(86400000000.0)).cast("long")
    return newest.withColumn("days_old", age).withColumn(
        "status",
        F.when(F.col("days_old").isNull(), "DISABLED").when(F.col("days_old") > max_age_days, "WARNING").otherwise("OK"),
    )


def group_members(groups: DataFrame, members: DataFrame, by=()) -> DataFrame:
    """Members of each group, quoted, with the group's size; the highest group of each ``by`` is left out."""
    by = columns(by)
    highest = F.max("group_no").over(Window.partitionBy(*by))
    kept = groups.withColumn("_highest", highest).filter(F.col("group_no") != F.col("_highest"))
    kept = kept.select(*by, "group_no", (F.col("bytes") / MEG).alias("size_mb"))
    quoted = members.select(*by, "group_no", F.concat(F.lit("'"), "member", F.lit("'")).alias("member"))
    return quoted.join(kept, [*by, "group_no"])
