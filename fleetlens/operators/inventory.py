"""Inventory, topology, blackouts and check selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import cat, columns, not_disabled, ntz
from fleetlens.sinks.tables import update_matching


def host_label(server: str = "server", host: str = "physical_server_abbrev", cluster: str = "cluster_name") -> Column:
    """'server', or 'server (host)' for an alias, then ' [cluster] ' when there is one."""
    alias = F.when(F.col(server) == F.col(host), F.col(server)).otherwise(cat(F.col(server), " (", F.col(host), ")"))
    tail = F.when(F.col(cluster).isNotNull(), cat(" [", F.col(cluster), "] "))
    return cat(alias, tail)


def active_targets(databases: DataFrame, servers: DataFrame, host_pattern: str = "%") -> DataFrame:
    """Enabled databases on enabled servers, with a decorated host label."""
    hosts = servers.filter(
        not_disabled()
        & (F.upper("server").like(host_pattern) | F.upper("physical_server_abbrev").like(host_pattern))
    ).drop("disabled")
    return (
        databases.filter(not_disabled())
        .drop("disabled")
        .join(hosts, "server")
        .select("database_name", "server", host_label().alias("host_label"))
    )


# --- blackouts ---------------------------------------------------------------------

WEEKDAY = "EEEE"


def _minutes() -> tuple[Column, Column]:
    """First and last minute of the day that a rule covers."""
    start = 60 * F.coalesce("hour_from", F.lit(0)) + F.coalesce("minute_from", F.lit(0))
    return start, 60 * F.coalesce("hour_to", F.lit(23)) + F.coalesce("minute_to", F.lit(59))


def rule_applies(ts: Column) -> Column:
    """True when a blackout rule row is in force at ``ts``.

    A rule names DAILY, a weekday or a day of the month; an optional date range
    and an optional minute-of-day range narrow it. No rule crosses midnight.
    """
    kind = F.col("sidskip_type")
    day = F.to_date(ts)
    minute = F.hour(ts) * 60 + F.minute(ts)
    start, stop = _minutes()
    on_day = (
        (kind == "DAILY")
        | (kind == F.upper(F.date_format(ts, WEEKDAY)))
        | (kind.try_cast("int") == F.dayofmonth(ts))
    )
    in_range = (F.coalesce(F.to_date("date_from"), day) <= day) & (F.coalesce(F.to_date("date_to"), day) >= day)
    return F.coalesce(on_day & in_range & (start <= minute) & (stop >= minute) & not_disabled(), F.lit(False))


def blackouts(rules: DataFrame, databases: DataFrame, as_of) -> DataFrame:
    """Databases to skip at ``as_of`` with the reason: rules in force, then disabled databases."""
    ruled = rules.filter(rule_applies(ntz(as_of))).select("database_name", F.col("sidskip_notes").alias("reason"))
    disabled = databases.filter(F.col("disabled") == "Y").select(
        "database_name", F.lit("(skipped as database marked as disabled)").alias("reason")
    )
    return ruled.unionByName(disabled)


def not_blacked_out(targets: DataFrame, rules: DataFrame, as_of) -> DataFrame:
    in_force = rules.filter(rule_applies(ntz(as_of))).select("database_name").filter(F.col("database_name").isNotNull())
    return targets.join(in_force.distinct(), "database_name", "left_anti")


def blackout_days(days: DataFrame, rules: DataFrame) -> DataFrame:
    """database_name, day, spans: the minutes of each day that rules cover, as disjoint spans in order.

    ``days`` holds distinct (database_name, day) rows. A day is of three kinds (daily, its weekday,
    its number) and meets the rules of its database by kind, an equality. Overlapping spans are
    joined, so a day has few, however many rules cover it.
    """
    day = F.col("day")
    kinds = F.array(F.lit("DAILY"), F.upper(F.date_format(day, WEEKDAY)), F.dayofmonth(day).cast("string"))
    kind = F.coalesce(F.col("sidskip_type").try_cast("int").cast("string"), F.col("sidskip_type"))
    start, stop = _minutes()
    known = rules.filter(not_disabled()).select(
        "database_name", kind.alias("kind"), F.to_date("date_from").alias("first"), F.to_date("date_to").alias("last"),
        start.alias("start"), stop.alias("stop"),
    )
    met = days.withColumn("kind", F.explode(kinds)).join(known, ["database_name", "kind"])
    met = met.filter((F.coalesce("first", day) <= day) & (F.coalesce("last", day) >= day) & (F.col("start") <= F.col("stop")))
    met = met.select("database_name", "day", "start", "stop").distinct()
    each = Window.partitionBy("database_name", "day").orderBy("start", "stop")
    reach = F.max("stop").over(each.rowsBetween(Window.unboundedPreceding, -1))
    met = met.withColumn("opens", F.when(F.col("start") <= reach + 1, 0).otherwise(1))
    met = met.withColumn("span", F.sum("opens").over(each.rowsBetween(Window.unboundedPreceding, 0)))
    spans = met.groupBy("database_name", "day", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("database_name", "day").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def rows_in_blackout(rows: DataFrame, rules: DataFrame, ts: str, inside: bool = True) -> DataFrame:
    """Rows whose own time falls inside (or outside) a blackout of their database.

    Rules are unfolded for the days that occur; a row meets one entry, that of its database and day.
    """
    spans, minute = F.col("_spans"), F.hour(ts) * 60 + F.minute(ts)
    dated = rows.withColumn("_day", F.to_date(ts))
    days = dated.select("database_name", F.col("_day").alias("day")).filter("database_name IS NOT NULL AND day IS NOT NULL").distinct()
    black = blackout_days(days, rules).select("database_name", F.col("day").alias("_day"), F.col("spans").alias("_spans"))
    covered = F.coalesce(F.exists(spans, lambda s: (s["start"] <= minute) & (s["stop"] >= minute)), F.lit(False))
    joined = dated.join(black, ["database_name", "_day"], "left").filter(covered if inside else ~covered)
    return joined.select(*rows.columns)


# --- check selection ------------------------------------------------------------------


def indicator_filter(df: DataFrame, wanted: Mapping[str, str]) -> DataFrame:
    """Keep rows whose indicator columns have the wanted Y or N; bad arguments are errors."""
    for name, value in wanted.items():
        if name not in df.columns:
            raise ValueError(f"column {name} not found")
        if value not in ("Y", "N"):
            raise ValueError(f"{name} must be Y or N, not {value!r}")
        df = df.filter(F.col(name) == value)
    return df


def _in_force(start: str, end: str, as_of) -> Column:
    now = ntz(as_of)
    return (F.coalesce(F.col(start), now) <= now) & (F.coalesce(F.col(end), now) >= now)


def _script_text() -> Column:
    return cat(F.col("script_name"), " ", F.col("param1"), " ", F.col("param2"))


def checks_to_run(
    checks: DataFrame,
    adds: DataFrame,
    skips: DataFrame,
    targets: DataFrame,
    as_of,
    *,
    types: Sequence[str] | None = None,
    on_master: str = "N",
    frequency: str = "D",
) -> DataFrame:
    """Checks per target: defaults for its version, plus additions, minus skips in force.

    Defaults obey the version range and the disabled flag; additions ignore both;
    both obey skips. ``targets`` has ``database_name`` and an integer
    ``version``. An open end of a version range is open. Versions are numbered in order
    together with the ends of the ranges, and ranges unfolded over these numbers, so checks
    meet targets through an equality; a target without a version meets none.
    """
    here = checks.filter(F.col("run_on_master") == on_master)
    every = F.col("frequency").contains(frequency)
    if types is not None:
        typed = F.col("script_type").isin(*types)
        here_default = here.filter(typed)
        adds = adds.filter(typed)
    else:
        here_default = here
    here_default = here_default.filter(every & not_disabled())
    low, high = F.col("db_version_from"), F.col("db_version_to")
    # As many points as there are releases and ends of ranges.
    ends = here_default.select(F.explode(F.array(low, high)).alias("version"))
    points = targets.select("version").unionByName(ends).filter(F.col("version").isNotNull()).distinct()
    points = points.withColumn("point", F.row_number().over(Window.orderBy("version")))
    last = points.agg(F.coalesce(F.max("point"), F.lit(0)).alias("point")).scalar()
    ranged = here_default.select("script_id", _script_text().alias("script"), "run_order", low.alias("low"), high.alias("high"))
    for end in ("low", "high"):
        ranged = ranged.join(points.select(F.col("version").alias(end), F.col("point").alias(f"{end}_point")), end, "left")
    reach = F.sequence(F.coalesce("low_point", F.lit(1)), F.coalesce(F.col("high_point"), last))
    reach = F.when(F.coalesce("low_point", F.lit(1)) <= F.coalesce(F.col("high_point"), last), reach)
    placed = targets.select("database_name", "version").join(points, "version").drop("version")
    ranged = ranged.withColumn("point", F.explode(reach))
    defaults = ranged.join(placed, "point").select("database_name", "script_id", "script", "run_order")
    added = (
        adds.filter(every & not_disabled() & _in_force("added_from", "added_to", as_of))
        .select("database_name", "script_id", "run_order")
        .join(here.select("script_id", _script_text().alias("script")), "script_id")
        .join(targets.select("database_name"), "database_name", "left_semi")
        .select("database_name", "script_id", "script", "run_order")
    )
    skipped = skips.filter(not_disabled() & _in_force("skipped_from", "skipped_to", as_of)).select(
        "database_name", "script_id"
    )
    return (
        defaults.unionByName(added)
        .join(skipped, ["database_name", "script_id"], "left_anti")
        .select("database_name", "script", "run_order")
        .distinct()
    )


def skipped_checks(skips: DataFrame, checks: DataFrame, adds: DataFrame, as_of) -> DataFrame:
    """The skipped checks of each target, unless an addition is in force for it."""
    added = adds.filter(not_disabled() & _in_force("added_from", "added_to", as_of)).select("database_name")
    return (
        skips.filter(not_disabled())
        .select("database_name", "script_id")
        .join(added, "database_name", "left_anti")
        .join(checks.select("script_id", "script_type"), "script_id")
        .select("database_name", cat(F.col("script_id"), "(", F.col("script_type"), ")").alias("skipped"))
    )


def resolve_check_set(
    sets: DataFrame, components: DataFrame, checks: DataFrame, databases: DataFrame, servers: DataFrame, set_id: str
) -> DataFrame:
    """Checks of one set per target: components that name a target, plus wildcard components for all targets.

    A wildcard component meets every target by definition. Targets are dealt to as many
    groups as the session has shuffle partitions, and each gets the short list of components.
    """
    deals = int(databases.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    title = F.translate(F.coalesce("title", "set_id"), " ", "_")
    chosen = sets.filter((F.col("set_id") == set_id) & not_disabled()).select("set_id", title.alias("title"))
    parts = (
        components.filter(not_disabled())
        .join(chosen, "set_id")
        .join(checks.select("script_id", "script_name", "param1", "param2"), "script_id")
        .select(
            "database_name",
            "script_name",
            "title",
            F.coalesce("param1", F.lit("null")).alias("param1"),
            F.coalesce("param2", F.lit("null")).alias("param2"),
        )
    )
    targets = (
        databases.filter(not_disabled())
        .join(servers.filter(not_disabled()).select("server"), "server")
        .select("database_name")
    )
    named = parts.filter(F.col("database_name").isNotNull()).join(targets, "database_name")
    detail = ["script_name", "title", "param1", "param2"]
    wild = parts.filter(F.col("database_name").isNull()).select(*detail).distinct()
    wild = wild.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = targets.withColumn("deal", F.pmod(F.hash("database_name"), F.lit(deals)))
    everywhere = dealt.join(wild, "deal").select("database_name", *detail)
    return named.select("database_name", *detail).unionByName(everywhere).distinct()


def types_present(checks: DataFrame, adds: DataFrame, script_type: str) -> DataFrame:
    """How many checks or additions have a type."""
    both = checks.select("script_type").unionByName(adds.select("script_type"))
    return both.agg(F.count_if(F.col("script_type") == script_type).alias("type_count"))


# --- consistency ----------------------------------------------------------------------


def duplicate_ids(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Rows whose id occurs more than once."""
    repeated = df.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col)
    return df.select(id_col, *cols).join(repeated, id_col, "left_semi")


def mixed_environment(databases: DataFrame, servers: DataFrame) -> DataFrame:
    """Databases that share a physical host with another one of the opposite production flag.

    Each host is summarised by the lowest and highest name per flag, which is
    enough to tell whether a differently named opposite exists; no pairs form.
    """
    placed = (
        databases.filter(not_disabled())
        .join(servers.filter(not_disabled()).select("server", "physical_server_abbrev"), "server")
        .select("physical_server_abbrev", "database_name", "production_ind")
    )
    name = {f: F.when(F.col("production_ind") == f, F.col("database_name")) for f in ("Y", "N")}
    hosts = placed.groupBy("physical_server_abbrev").agg(
        *[fn(name[f]).alias(f"_{fn.__name__}_{f}") for f in ("Y", "N") for fn in (F.min, F.max)]
    )
    me = F.col("database_name")
    opposite = F.when(
        F.col("production_ind") == "Y", (F.col("_min_N") != me) | (F.col("_max_N") != me)
    ).when(F.col("production_ind") == "N", (F.col("_min_Y") != me) | (F.col("_max_Y") != me))
    return (
        placed.join(hosts, "physical_server_abbrev")
        .filter(opposite)
        .select("physical_server_abbrev", "database_name", "production_ind")
    )


def placement_drift(servers: DataFrame, vms: DataFrame) -> DataFrame:
    """Servers found on another cluster than expected: WARNING if that cluster is known, ERROR if not."""
    expected = servers.filter(F.col("cluster_name").isNotNull() & not_disabled()).select(
        F.upper("physical_server_abbrev").alias("_host"), "physical_server_abbrev", F.col("cluster_name").alias("old_cluster")
    )
    actual = vms.select(F.upper("virtual_machine").alias("_host"), F.col("cluster_name").alias("new_cluster"))
    in_place = actual.select("_host", F.col("new_cluster").alias("old_cluster")).distinct()
    moved = expected.join(in_place, ["_host", "old_cluster"], "left_anti").join(
        actual.filter(F.col("new_cluster").isNotNull()), "_host"
    )
    known = expected.select(F.col("old_cluster").alias("new_cluster"), F.lit(True).alias("_known")).distinct()
    notes = F.when(F.col("_known"), "WARNING: Known Cluster").otherwise("ERROR: Unknown Cluster!")
    return moved.join(known, "new_cluster", "left").select(
        "physical_server_abbrev", "old_cluster", "new_cluster", notes.alias("cluster_notes")
    )


def cluster_counts(databases: DataFrame, servers: DataFrame) -> DataFrame:
    """Distinct physical servers and database count per cluster."""
    per_server = databases.filter(not_disabled()).groupBy("server").agg(F.count("*").alias("n"))
    return (
        servers.filter(not_disabled())
        .join(per_server, "server", "left")
        .groupBy(F.coalesce("cluster_name", F.lit("(No cluster)")).alias("cluster_name"))
        .agg(F.count_distinct("physical_server_abbrev").alias("server_count"), F.sum("n").alias("instance_count"))
    )


def cluster_members(servers: DataFrame) -> DataFrame:
    """Members of each cluster."""
    return (
        servers.filter(not_disabled())
        .select(F.coalesce("cluster_name", F.lit("(No Cluster)")).alias("cluster_name"), F.col("physical_server_abbrev").alias("member"))
        .distinct()
    )


def orphan_servers(servers: DataFrame, databases: DataFrame) -> DataFrame:
    """Enabled servers without enabled databases, aliases left out.

    Null server names on the database side are dropped first, so one unnamed
    database cannot hide every orphan.
    """
    used = databases.filter(not_disabled() & F.col("server").isNotNull()).select("server")
    aliases = servers.filter(F.col("physical_server_abbrev") != F.col("server")).select("server")
    return (
        servers.filter(not_disabled())
        .select("server")
        .join(used, "server", "left_anti")
        .join(aliases, "server", "left_anti")
        .distinct()
    )


def names_not_listed(names: DataFrame, listed: DataFrame, name: str) -> DataFrame:
    return names.join(listed.select(name), name, "left_anti")


def ping_targets(servers: DataFrame, pattern: str = "%") -> DataFrame:
    """Distinct physical hosts enabled for probing."""
    match = F.upper("server").like(pattern) | F.upper("physical_server_abbrev").like(pattern)
    return (
        servers.filter(not_disabled() & (F.col("ping_disabled") != "Y") & match).select("physical_server").distinct()
    )


def instance_labels(instances: DataFrame) -> DataFrame:
    """'server', or 'server++instance' for a named instance."""
    return (
        instances.filter(not_disabled())
        .select(F.concat_ws("++", "server", "instance_name").alias("label"))
        .distinct()
    )


def app_databases(databases: DataFrame, skips: DataFrame, server: str | None = None) -> DataFrame:
    """Enabled application databases whose instance is not skipped."""
    rows = databases.filter(not_disabled())
    if server is not None:
        rows = rows.filter(F.col("server") == server)
    in_force = skips.filter(not_disabled()).select("server", "instance_name")
    return rows.join(in_force, ["server", "instance_name"], "left_anti")


def alias_to_physical(aliases: DataFrame, servers: DataFrame, alias: str = "alias") -> DataFrame:
    """Physical host of each alias, ignoring case."""
    hosts = servers.select(F.lower("server").alias("_name"), "physical_server")
    return aliases.withColumn("_name", F.lower(alias)).join(hosts, "_name").select(alias, "physical_server")


def identity_reconcile(
    reported: DataFrame, databases: DataFrame, servers: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Reported duplicate ids, and the inventory with ids updated where name and host both agree.

    A database reported with several ids keeps the one it has, since nothing tells which is right.
    """
    duplicates = duplicate_ids(reported, "dbid", ["database_name", "host_name"])
    placed = databases.join(
        servers.select("server", F.col("physical_server_abbrev").alias("host_name")), "server"
    ).select("database_name", "server", "host_name")
    agreed = reported.join(placed, ["database_name", "host_name"]).groupBy("database_name", "server")
    agreed = agreed.agg(F.min("dbid").alias("dbid"), F.max("dbid").alias("_most")).filter("dbid = _most").drop("_most")
    return duplicates, update_matching(databases, agreed, ["database_name", "server"], ["dbid"])


# --- validation -------------------------------------------------------------------------


def _row_key(key) -> Column:
    return F.concat_ws("|", *[F.col(k).cast("string") for k in columns(key)])


def row_rules(domains=None, ranges=None, not_null=()) -> dict[str, tuple[Column, str]]:
    """Rules that one row can break: by name, the condition that breaks it and the column it is about."""
    tests: dict[str, tuple[Column, str]] = {}
    for c, allowed in (domains or {}).items():
        tests[f"domain {c}"] = ~F.col(c).isin(*allowed), c
    for c, (lo, hi) in (ranges or {}).items():
        tests[f"range {c}"] = ~F.col(c).between(lo, hi), c
    for c in not_null:
        tests[f"not null {c}"] = F.col(c).isNull(), c
    return tests


def _violations(tests: dict[str, tuple[Column, str]]) -> Column:
    """The rules a row breaks, as an array of (rule, value)."""
    broken = [F.when(c, F.struct(F.lit(name).alias("rule"), F.col(of).cast("string").alias("value"))) for name, (c, of) in tests.items()]
    return F.array_compact(F.array(*broken))


GATE = "gate"


def gated_write(df: DataFrame, path: str, key, *, domains=None, ranges=None, not_null=(), mode: str = "overwrite") -> dict[str, int]:
    """Write rows and hold back those that break a rule, in one pass; returns how many rows break each rule.

    Rows go to ``path`` under ``gate=accepted`` or ``gate=quarantine``, the latter with the rules
    they break. Counts are taken by the pass that writes. As in a CHECK constraint, a null passes
    domain and range rules. For a stream, ``foreachBatch`` calls this with a path for each batch.
    """
    tests = row_rules(domains, ranges, not_null)
    seen = Observation()
    counts = [F.count_if(broken).alias(name) for name, (broken, _) in tests.items()]
    marked = df.withColumns({"row_key": _row_key(key), "violations": _violations(tests)})
    marked = marked.observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
    side = F.when(F.size("violations") == 0, "accepted").otherwise("quarantine")
    marked.withColumn(GATE, side).write.mode(mode).partitionBy(GATE).parquet(path)
    return dict(seen.get)


def accepted(spark, path: str, like: DataFrame) -> DataFrame:
    """The rows that passed the gate, with the columns of ``like``."""
    return _gate(spark, path, like).filter(F.col(GATE) == "accepted").select(*like.columns)


def quarantined(spark, path: str, like: DataFrame) -> DataFrame:
    """Held-back rows as (rule, row_key, value), one for each rule they break."""
    rows = _gate(spark, path, like).filter(F.col(GATE) == "quarantine")
    return rows.select("row_key", F.explode("violations").alias("v")).select("v.rule", "row_key", "v.value")


def _gate(spark, path: str, like: DataFrame) -> DataFrame:
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema)
    extra = f"row_key string, violations array<struct<rule:string,value:string>>, {GATE} string"
    return spark.read.schema(f"{fields}, {extra}").parquet(path)


def validate(
    df: DataFrame,
    key: Sequence[str],
    *,
    domains: Mapping[str, Sequence[str]] | None = None,
    ranges: Mapping[str, tuple[float, float]] | None = None,
    not_null: Sequence[str] = (),
    unique: Sequence[Sequence[str]] = (),
    references: Mapping[str, tuple[DataFrame, str]] | None = None,
) -> DataFrame:
    """Violations as ``(rule, row_key, value)`` rows.

    All row-local rules are tested in one pass. As in a CHECK constraint, a null
    passes domain, range and reference rules.
    """
    row_key = _row_key(key)
    tests = row_rules(domains, ranges, not_null)
    found = []
    if tests:
        broken = df.select(row_key.alias("row_key"), F.explode(_violations(tests)).alias("v"))
        found.append(broken.select("v.rule", "row_key", "v.value"))
    for cols in unique:
        repeated = df.groupBy(*cols).count().filter("count > 1")
        found.append(
            repeated.select(
                F.lit("unique " + ",".join(cols)).alias("rule"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in cols]).alias("row_key"),
                F.col("count").cast("string").alias("value"),
            )
        )
    for c, (parent, parent_key) in (references or {}).items():
        known = parent.select(F.col(parent_key).alias(c)).distinct()
        lost = df.filter(F.col(c).isNotNull()).select(row_key.alias("row_key"), c).join(known, c, "left_anti")
        found.append(
            lost.select(F.lit(f"reference {c}").alias("rule"), "row_key", F.col(c).cast("string").alias("value"))
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
