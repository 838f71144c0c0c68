"""Account, job, object, parameter and instance health.

Names of accounts, jobs, objects and parameters repeat in every database. ``by`` names the columns
that tell databases apart; they are part of every join and grouping and stay in the result.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import cat, columns, instant, micros_between, ntz, short_host

# Fixed values that results depend on.
EXPIRED_STATES = ("EXPIRED", "EXPIRED(GRACE)")
LOCKED_STATES = ("LOCKED", "EXPIRED & LOCKED")


def _ahead(as_of, days: float):
    return ntz(instant(as_of) + timedelta(days=days))


def password_expiry(users: DataFrame, as_of, days: int = 31, by=()) -> DataFrame:
    """Open accounts about to expire, and accounts already expired."""
    due = (F.col("account_status") == "OPEN") & (F.col("expiry_date") < _ahead(as_of, days))
    tense = F.when(F.col("expiry_date") < ntz(as_of), "expired").otherwise("expires")
    return users.filter(due | F.col("account_status").isin(*EXPIRED_STATES)).select(
        *columns(by), "username", "expiry_date", "profile", "account_status", tense.alias("tense")
    )


def password_expiry_message(issues: DataFrame, by=()) -> DataFrame:
    """One message with the number of accounts that have expiry issues."""
    n = F.col("n")
    text = cat(
        "** WARNING - ", n.cast("string"), F.when(n == 1, " user").otherwise(" users"), " found with Password Expiry Issues **"
    )
    return (
        issues.groupBy(*columns(by))
        .agg(F.count("*").alias("n"))
        .select(*columns(by), F.when(n < 1, "** No Password Expiry Issues Found **").otherwise(text).alias("message"))
    )


def stale_passwords(
    users: DataFrame,
    defaults: DataFrame,
    as_of,
    days: int = 365,
    exclude: Sequence[str] = (),
    exclude_like: Sequence[str] = ("APEX%",),
    by=(),
) -> DataFrame:
    """Accounts whose password is older than ``days``, shipped accounts left out.

    Null names in ``defaults`` are ignored rather than hiding every account.
    """
    rows = users.filter(F.col("ptime").isNotNull() & (F.col("ptime") < _ahead(as_of, -days)))
    for pattern in exclude_like:
        rows = rows.filter(~F.col("name").like(pattern))
    if exclude:
        rows = rows.filter(~F.col("name").isin(*exclude))
    by = columns(by)
    shipped = defaults.select(*by, F.col("user_name").alias("name")).filter(F.col("name").isNotNull())
    age = micros_between(ntz(as_of), F.col("ptime")) / F.lit(86400000000.0)
    return rows.join(shipped, [*by, "name"], "left_anti").select(*by, "name", "ptime", F.round(age).cast("long").alias("days_ago"))


def default_password_users(defaults: DataFrame, users: DataFrame, by=()) -> DataFrame:
    """Unlocked accounts that still have a shipped password."""
    by = columns(by)
    live = users.filter(~F.col("account_status").isin(*LOCKED_STATES))
    return live.join(defaults.select(*by, "username").distinct(), [*by, "username"], "left_semi").select(*by, "username", "account_status")


def service_account_expiry(users: DataFrame, names: Sequence[str], as_of, days: int = 31, by=()) -> DataFrame:
    """Warning or information line per service account; no expiry date counts as a year away."""
    soon = F.coalesce("expiry_date", _ahead(as_of, 365)) < _ahead(as_of, days)
    when = F.coalesce(F.date_format("expiry_date", "dd-MMM-yy"), F.lit("** No Expiry Date Set **"))
    text = cat("The password for ", F.col("username"), " expires on ", when)
    return users.filter(F.col("username").isin(*names)).select(
        *columns(by), "username", F.when(soon, cat("WARNING: ", text)).otherwise(text).alias("expiry_info")
    )


def broken_jobs(jobs: DataFrame, by=()) -> DataFrame:
    """Every broken or failed job with its state; a shorter list is a filter on the result."""
    broken, failed = F.col("broken") == "Y", F.col("failures") > 0
    state = F.when(broken, "Broken.").otherwise("Not Broken.").alias("broken")
    return jobs.filter(broken | failed).select(*columns(by), "job", "log_user", "last_date", state, "failures", "what")


def broken_jobs_message(jobs: DataFrame, by=()) -> DataFrame:
    """How many jobs are broken or failed."""
    bad = F.coalesce((F.col("broken") == "Y") | (F.col("failures") > 0), F.lit(False))
    n = F.col("n")
    text = F.when(n < 1, "** No Unsuccessful or Broken Jobs Found **").otherwise(
        cat("** WARNING - ", n.cast("string"), " failed or broken ", F.when(n == 1, "job").otherwise("jobs"), " found **")
    )
    return jobs.groupBy(*columns(by)).agg(F.count_if(bad).alias("n")).select(*columns(by), text.alias("message"))


def locked_stats(tables: DataFrame, by=()) -> DataFrame:
    """Number of tables with locked statistics outside system owners, with its verdict."""
    locked = F.col("stattype_locked").isNotNull() & ~F.col("owner").like("%SYS%")
    return (
        tables.groupBy(*columns(by))
        .agg(F.count_if(locked).alias("locked_tables"))
        .withColumn("status", F.when(F.col("locked_tables") > 0, "WARNING").otherwise("OK"))
    )


def recent_objects(objects: DataFrame, dropped: DataFrame, db_created, as_of, days: int = 32, by=()) -> DataFrame:
    """Objects created lately, well after the database itself, and not in the recycle bin.

    ``db_created`` is one moment, or the name of a column of ``objects`` where databases differ. An
    object is told from a dropped one by database, name and, where ``dropped`` has it, owner.
    """
    by = columns(by)
    lately = ntz(instant(as_of) - timedelta(days=days))
    kept = objects.filter(
        (F.col("created") > lately)
        & ~F.col("object_name").like("WRH$_FILESTATXS%")
        & ~F.col("object_name").like('"BIN "%')
        & ~F.col("object_type").like("%PARTITION%")
    )
    own = isinstance(db_created, str) and db_created in objects.columns
    kept = kept.filter(F.col("created") > (F.col(db_created) + F.expr("INTERVAL 1 DAY") if own else ntz(instant(db_created) + timedelta(days=1))))
    same = [*by, "object_name", *(["owner"] if "owner" in dropped.columns else [])]
    label = cat(F.col("owner"), ".", F.col("object_name"), " (", F.col("object_type"), ")")
    return kept.join(dropped.select(*same), same, "left_anti").select(*by, label.alias("object"), "created")


def count_by_owner(dropped: DataFrame, by=()) -> DataFrame:
    return dropped.groupBy(*columns(by), "owner").agg(F.count("*").alias("recyclebin_objects"))


def components_down(components: DataFrame, queues: DataFrame, by=()) -> DataFrame:
    """Components meant to start by themselves that are not running, with their queue if known."""
    by = columns(by)
    return (
        components.filter((F.col("startup_mode") == "AUTOMATIC") & (F.col("component_status") != "RUNNING"))
        .join(queues.select(*by, "queue_id", "queue_name"), [*by, "queue_id"], "left")
        .select(*by, "component_name", "startup_mode", "component_status", "queue_name")
    )


def non_default_parameters(params: DataFrame, by=()) -> DataFrame:
    return params.filter(F.col("isdefault") == "FALSE").select(*columns(by), cat(F.col("name"), " => ", F.col("value")).alias("param"))


def archive_destinations(params: DataFrame, by=()) -> DataFrame:
    kept = params.filter(
        F.col("name").like("log_archive_dest%") & F.col("value").isNotNull() & ~F.col("name").like("%state%")
    )
    return kept.select(*columns(by), cat(F.rpad("name", 20, " "), " => ", F.col("value")).alias("dest"))


def link_list(links: DataFrame, by=()) -> DataFrame:
    text = cat(F.col("owner"), ".", F.col("db_link"), " =>", F.col("username"), "@", F.col("host"))
    return links.select(*columns(by), text.alias("dblink"))


def uptime_text(started, as_of):
    """'n Days n Hours n Minutes n Seconds' up to ``as_of``."""
    secs = F.floor(micros_between(ntz(as_of), started) / 1000000)
    part = [F.floor(secs / 86400), F.floor(secs / 3600) % 24, F.floor(secs / 60) % 60, secs % 60]
    names = [" Days ", " Hours ", " Minutes ", " Seconds"]
    return cat(*[x for p, n in zip(part, names) for x in (p.cast("long").cast("string"), n)])


def instance_card(instances: DataFrame, databases: DataFrame, banners: DataFrame, as_of, key: str = "dbid") -> DataFrame:
    """Edition, version, host, platform, log mode and uptime per instance of the fleet."""
    edition = (
        banners.groupBy(key)
        .agg(F.count_if(F.col("banner").like("%Enterprise Edition%")).alias("n"))
        .select(key, F.when(F.col("n") > 0, "Enterprise Edition").otherwise("Standard Edition").alias("edition"))
    )
    return (
        instances.join(databases.select(key, "log_mode", "platform_name", "endian_format"), key)
        .join(edition, key, "left")
        .select(
            key,
            "instance_name",
            "edition",
            "version",
            short_host("host_name").alias("host"),
            cat(F.col("platform_name"), " ", F.col("endian_format"), " Endian").alias("platform"),
            "log_mode",
            uptime_text(F.col("startup_time"), as_of).alias("uptime"),
        )
    )

