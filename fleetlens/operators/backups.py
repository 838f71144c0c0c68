"""Backup reports over job history and its set and piece details.

Job history is reduced to one row per database (and kind) before it meets
anything else; set details are reduced to one row per session before they are
joined to jobs. No ranking over a whole database's history is needed.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import (
    cat,
    columns,
    directory_of,
    instant,
    micros_between,
    midnight,
    ntz,
)
from fleetlens.operators.latest import newest_first, top_rows

DONE = ("COMPLETED", "COMPLETED WITH WARNINGS")
SESSION = ["db_key", "session_key"]


def _since(as_of, days: int) -> Column:
    return ntz(instant(as_of) - timedelta(days=days))


def marked_status(status: str = "status") -> Column:
    return F.when(F.col(status) == "FAILED", "FAILED    <---- N.B.").otherwise(F.col(status))


def is_database(kind: str = "input_type") -> Column:
    return F.col(kind).startswith("DB")


def is_log(kind: str = "input_type") -> Column:
    return F.col(kind).startswith("ARC")


def backup_details(jobs: DataFrame, sets: DataFrame, dbs: DataFrame, as_of, days: int = 7, merged: bool = False) -> DataFrame:
    """Latest start per database, kind and status within ``days``.

    By default incremental jobs are split by the level of their sets and jobs
    without sets drop out. With ``merged`` full and incremental jobs are both
    called DATABASE and sets do not matter.
    """
    recent = jobs.filter(F.col("start_time") > _since(as_of, days)).join(
        dbs.select("db_key", "dbid", F.col("name").alias("db_name")), ["db_key", "db_name"]
    )
    kind = F.col("input_type")
    cols = ["dbid", "db_name", kind.alias("source_type"), "status", "start_time"]
    if merged:
        rows = recent.select(
            *cols, F.when(kind.isin("DB FULL", "DB INCR"), "DATABASE").otherwise(kind).alias("input_type"), F.lit(0).alias("level")
        )
    else:
        levels = sets.select(*SESSION, F.col("incremental_level").alias("level")).distinct()
        named = F.when(F.col("level") == 0, "DB FULL").otherwise("DB INCR").alias("input_type")
        split = recent.filter(kind == "DB INCR").join(levels, SESSION).select(*cols, named, "level")
        rows = recent.filter(kind != "DB INCR").select(*cols, kind, F.lit(0).alias("level")).unionByName(split)
    # Full and incremental sources are summarised apart, so one reported kind may show two times.
    return (
        rows.groupBy("dbid", "db_name", "input_type", "source_type", "level", marked_status().alias("status"))
        .agg(F.max("start_time").alias("last_time"))
        .select("dbid", "db_name", "input_type", "status", "last_time")
        .distinct()
    )


def last_backup(jobs: DataFrame, sets: DataFrame, dbs: DataFrame, inventory: DataFrame, as_of, days: int = 365) -> DataFrame:
    """Newest non-log backup per database id; the label shows both names when they differ."""
    backed = (
        jobs.filter((F.col("start_time") > _since(as_of, days)) & (F.col("input_type") != "ARCHIVELOG"))
        .join(sets.select(*SESSION), SESSION, "left_semi")
        .join(dbs.select("db_key", "dbid", F.col("name").alias("db_name")), ["db_key", "db_name"])
        .select("dbid", "db_name", marked_status().alias("status"), F.col("start_time").alias("last_time"))
    )
    newest = top_rows(backed, "dbid", newest_first("last_time"), ties=True)
    label = cat(
        F.col("database_name"), F.when(F.col("db_name") != F.col("database_name"), cat(" (", F.col("db_name"), ")"))
    )
    return (
        newest.join(inventory.select("dbid", "database_name"), "dbid")
        .select(label.alias("db"), "status", "last_time", "dbid")
        .distinct()
    )


def missing_backups(sets: DataFrame, jobs: DataFrame, dbs: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Databases that were backed up once but have no completed database job within ``days``."""
    ever = sets.filter(F.col("backup_type").isin("D", "I")).select("db_key").distinct()
    lately = jobs.filter(
        (F.col("start_time") > _since(as_of, days)) & is_database() & (F.col("status") == "COMPLETED")
    ).select("db_key")
    return (
        ever.join(lately, "db_key", "left_anti")
        .join(dbs, "db_key")
        .select(F.col("name").alias("db_name"), "dbid")
    )


def backup_directories(pieces: DataFrame, dbs: DataFrame) -> DataFrame:
    """Distinct directories of disk pieces per database."""
    found = (
        pieces.filter(F.col("device_type") == "DISK")
        .select("db_key", directory_of("handle").alias("directory"))
        .distinct()
    )
    return found.join(dbs.select("db_key", "name"), "db_key").select("name", "directory").distinct()


def live_backup_directories(
    logs: DataFrame,
    datafiles: DataFrame,
    controls: DataFrame,
    params: DataFrame,
    datafile_state: DataFrame,
    pieces: DataFrame,
    dbs: DataFrame,
) -> DataFrame:
    """Directories of available disk pieces of four kinds; dropped data files do not count.

    The kinds are reduced to one list of backup sets, so pieces are read and
    joined once.
    """
    kept = datafile_state.filter(F.col("drop_time").isNull()).select("db_key", "file_no")
    alive = datafiles.filter(F.col("status") == "A").join(kept, ["db_key", "file_no"], "left_semi")
    wanted = alive.select("db_key", "bs_key")
    for part in (logs, controls, params):
        wanted = wanted.unionByName(part.filter(F.col("status") == "A").select("db_key", "bs_key"))
    found = (
        pieces.filter(F.col("media").isNull())
        .join(wanted, ["db_key", "bs_key"], "left_semi")
        .select("db_key", directory_of("handle").alias("directory"))
        .distinct()
    )
    return found.join(dbs, "db_key").select("name", "dbid", "directory").distinct()


def catalog_summary(details: DataFrame, inventory: DataFrame, servers: DataFrame) -> DataFrame:
    """Backup details beside the inventory name and host."""
    label = cat(
        F.col("database_name"), F.when(F.col("db_name") != F.col("database_name"), cat(" (", F.col("db_name"), ")"))
    )
    host = cat(
        F.col("server"),
        F.when(F.col("physical_server") != F.col("server"), cat(" (", F.col("physical_server"), ")")),
    )
    return (
        details.join(inventory.select("dbid", "database_name", "server"), "dbid")
        .join(servers.select("server", "physical_server"), "server")
        .select("database_name", label.alias("db_name"), host.alias("server"), "input_type", "status", "last_time")
    )


def directories_by_host(directories: DataFrame, inventory: DataFrame, servers: DataFrame) -> DataFrame:
    return (
        directories.select("dbid", "directory")
        .join(inventory.select("dbid", "database_name", "server"), "dbid")
        .join(servers.select("server", "physical_server_abbrev"), "server")
        .select(
            cat(F.col("physical_server_abbrev"), " (", F.col("database_name"), ")").alias("name"),
            cat("DBID:", F.col("dbid").cast("string")).alias("dbid"),
            "directory",
        )
    )


def backup_verdict(jobs: DataFrame, policy: DataFrame, as_of) -> DataFrame:
    """DISABLED, NOT APPLICABLE, ERROR or OK per database.

    ``policy`` has ``db_key``, ``check_days`` and ``log_mode``. Jobs are first
    reduced to one row per database and start day, so the age limit, which
    differs per database, is applied to that short list.
    """
    counted = is_database() | (F.col("input_type") == "ARCHIVELOG")
    shown = F.col("input_type").startswith("DB ") | (F.col("input_type") == "ARCHIVELOG")
    done = F.col("status").isin(*DONE)
    # Day d holds the starts strictly after d's midnight, up to and including the next one.
    start_day = F.to_date(F.col("start_time") - F.expr("INTERVAL '0.000001' SECOND"))
    card = F.struct("status", "input_type", "start_time", "end_time")
    finished = shown & (F.col("status") != "RUNNING")
    daily = (
        jobs.filter(counted)
        .groupBy("db_key", start_day.alias("day"))
        .agg(
            F.max(F.when(done, F.lit(True))).alias("any_done"),
            F.max(F.when(done & is_database(), F.col("start_time"))).alias("last_db"),
            F.max_by(card, F.when(finished, F.struct("end_time", "session_key"))).alias("card"),
            F.max(F.when(finished, F.struct("end_time", "session_key"))).alias("card_order"),
        )
    )
    limit = F.date_sub(F.lit(midnight(as_of).date()), F.col("check_days"))
    in_time = F.col("day") >= limit
    per_db = (
        policy.join(daily, "db_key", "left")
        .groupBy("db_key", "check_days", "log_mode")
        .agg(
            F.coalesce(F.max(F.when(in_time, F.col("any_done"))), F.lit(False)).alias("recent"),
            F.max("last_db").alias("last_database_backup"),
            F.max_by("card", F.when(in_time, F.col("card_order"))).alias("card"),
        )
    )
    ok = F.col("card.status").isin(*DONE)
    verdict = (
        F.when(F.col("check_days") == 0, "DISABLED")
        .when(F.col("log_mode") == "NOARCHIVELOG", "NOT APPLICABLE")
        .when(~F.col("recent"), "ERROR: none recent")
        .when(ok, "OK")
        .otherwise("ERROR: last failed")
    )
    return per_db.select(
        "db_key",
        "check_days",
        verdict.alias("verdict"),
        F.col("card.status").alias("last_status"),
        F.col("card.input_type").alias("last_type"),
        F.col("card.end_time").alias("last_end"),
        (~F.col("recent") & F.col("last_database_backup").isNull()).alias("no_database_backup"),
    )


def last_of_each_kind(jobs: DataFrame, sets: DataFrame, as_of) -> DataFrame:
    """Per database: last full, incremental and log backup of the week, last failures of the month."""
    week, month = _since(as_of, 7), _since(as_of, 32)
    sessions = (
        sets.filter((F.col("start_time") > week) & F.col("incremental_level").isin(0, 1))
        .groupBy(*SESSION, F.when(F.col("incremental_level") == 0, "full").otherwise("incremental").alias("kind"))
        .agg(F.max("start_time").alias("order_time"))
    )
    from_sets = (
        jobs.filter(is_database())
        .join(sessions, SESSION)
        .select("db_key", "kind", "order_time", "session_key", "status", "start_time")
    )
    failed = F.col("status") == "FAILED"
    kinds = F.array_compact(
        F.array(
            F.when(is_log() & (F.col("start_time") > week), "log"),
            F.when(is_database() & failed, "database failure"),
            F.when(is_log() & failed, "log failure"),
        )
    )
    from_jobs = (
        jobs.filter(F.col("start_time") > month)
        .select("db_key", F.explode(kinds).alias("kind"), F.col("start_time").alias("order_time"), "session_key", "status", "start_time")
    )
    return (
        from_sets.unionByName(from_jobs)
        .groupBy("db_key", "kind")
        .agg(F.max_by(F.struct("status", "start_time"), F.struct("order_time", "session_key")).alias("last"))
        .select("db_key", "kind", "last.status", "last.start_time")
    )


def last_success_and_last_any(jobs: DataFrame, dbs: DataFrame) -> DataFrame:
    """Last successful and last database backup per database, with not-found messages."""
    order = F.struct("start_time", "session_key")
    per_db = (
        jobs.filter(is_database())
        .groupBy("db_key")
        .agg(
            F.max(F.when(F.col("status").isin(*DONE), F.col("start_time"))).alias("last_success"),
            F.max("start_time").alias("last_start"),
            F.max_by("status", order).alias("last_status"),
        )
    )
    return dbs.select("db_key", "name").join(per_db, "db_key", "left").select(
        "db_key",
        "name",
        "last_success",
        "last_start",
        "last_status",
        F.when(F.col("last_success").isNull(), "No Recent Successful Database Backups Found").alias("success_note"),
        F.when(F.col("last_start").isNull(), "No Recent Database Backups Found").alias("any_note"),
    )


def _duration() -> Column:
    return micros_between(F.col("end_time"), F.col("start_time"))


def rate_mb(size: str = "input_bytes") -> Column:
    seconds = _duration() / F.lit(1000000.0)
    return F.try_divide(F.try_divide(F.col(size).cast("double"), seconds), F.lit(1048576.0))


def backup_speed(jobs: DataFrame, as_of, days: int = 32, name_pattern: str = "%") -> DataFrame:
    """Duration, throughput and compression of recent database backups that did not fail."""
    seconds = F.floor(_duration() / 1000000)
    return jobs.filter(
        F.col("input_type").startswith("DB ")
        & (F.col("start_time") > _since(as_of, days))
        & F.col("db_name").like(name_pattern)
        & (F.col("status") != "FAILED")
    ).select(
        "db_name",
        "start_time",
        "end_time",
        F.floor(seconds / 3600).cast("long").alias("hours"),
        (F.floor(seconds / 60) % 60).cast("long").alias("minutes"),
        (seconds % 60).cast("long").alias("seconds"),
        rate_mb().alias("mb_per_sec"),
        "compression_ratio",
    )


def latest_job_card(jobs: DataFrame) -> DataFrame:
    """Newest database job and newest log job per database."""
    kind = F.when(F.col("input_type").startswith("DB "), "database").when(F.col("input_type") == "ARCHIVELOG", "log")
    rows = jobs.withColumn("job_class", kind).filter(F.col("job_class").isNotNull())
    newest = top_rows(rows, ["db_key", "job_class"], newest_first("end_time", "session_key"))
    return newest.select(
        "db_key", "job_class", "input_type", "status", "start_time", "end_time", "input_bytes", rate_mb().alias("mb_per_sec")
    )


def backup_matrix(jobs: DataFrame, details: DataFrame, sets: DataFrame, output: DataFrame, as_of, days: int = 7, by=()) -> DataFrame:
    """Recent jobs with piece counts by class and the lowest instance that wrote output.

    Recent jobs are the small side: they prune both detail tables before those
    are summed. ``by`` tells databases apart; session keys and stamps repeat in each.
    """
    by = columns(by)
    session = [*by, "session_key"]
    stamp = [*by, "set_stamp", "set_count"]
    recent = jobs.filter(F.col("start_time") > ntz(midnight(as_of, -days)))
    wanted = recent.select(*session).distinct()
    kind = cat(F.col("backup_type"), F.col("incremental_level").cast("string"))

    def pieces(when: Column, name: str) -> Column:
        return F.sum(F.when(when, F.col("pieces")).otherwise(0)).alias(name)

    scanned = sets.filter(F.col("input_file_scan_only") == "NO").select(*stamp)
    counts = (
        details.join(wanted, session, "left_semi")
        .join(scanned, stamp, "left_semi")
        .groupBy(*session)
        .agg(
            pieces(F.col("controlfile_included") == "YES", "cf"),
            pieces((F.col("controlfile_included") == "NO") & (kind == "D"), "df"),
            pieces(kind == "D0", "i0"),
            pieces(kind == "I1", "i1"),
            pieces(F.col("backup_type") == "L", "l"),
        )
    )
    writer = (
        output.join(wanted, session, "left_semi").groupBy(*session).agg(F.min("inst_id").alias("inst_id"))
    )
    brief = (
        F.when(F.col("status") == "COMPLETED WITH ERRORS", "ERRORS")
        .when(F.col("status") == "COMPLETED WITH WARNINGS", "WARNINGS")
        .otherwise(F.col("status"))
    )
    return (
        recent.join(counts, session, "left")
        .join(writer, session, "left")
        .select(
            *session, "start_time", "end_time", F.round(F.col("output_bytes") / 1048576).cast("long").alias("output_mb"),
            brief.alias("status"), "input_type", "cf", "df", "i0", "i1", "l", "inst_id",
        )
    )


BACKUP_TYPES = {"I": "Incremental DB", "D": "DB", "L": "Archivelog"}


def latest_by_type(sets: DataFrame, by=()) -> DataFrame:
    """Newest completion per backup type."""
    name = F.create_map(*[F.lit(x) for pair in BACKUP_TYPES.items() for x in pair])
    return sets.groupBy(*columns(by), F.try_element_at(name, F.col("backup_type")).alias("backup_type")).agg(
        F.max("completion_time").alias("latest_backup")
    )


def no_backups_warning(latest: DataFrame) -> DataFrame:
    """One warning row when :func:`latest_by_type` found nothing."""
    return latest.agg(F.count("*").alias("n")).filter("n = 0").select(
        F.lit("WARNING: No detected backups but database is in archivelog mode..").alias("message")
    )


def backup_age_policy(dbs: DataFrame, control: DataFrame, as_of, name: str = "database_name", default: int = 1) -> DataFrame:
    """Days to check per database: blackout (0), then exact, then fuzzy rule, then the default.

    A fuzzy rule names a text at the start, end or anywhere in the database name.
    Instead of testing every name against every rule, each name is cut into the
    pieces whose lengths occur in the fuzzy rules, and pieces meet rules by equality.
    Fuzzy rules are written by hand and few; they are sent to the pieces, which are many.
    Rule names are taken literally. Equal-ranked rules: the fewest days win.
    """
    now = ntz(as_of)
    blackout = control.filter((F.col("blackout_from") <= now) & (F.col("blackout_to") >= now)).select(
        F.col("database_name").alias(name), F.lit(1).alias("rank"), F.lit(0).alias("days")
    )
    rules = control.filter(F.col("blackout_from").isNull() & F.col("blackout_to").isNull()).select(
        F.col("database_name").alias("piece"), F.col("check_days").alias("days"), "fuzzy_char_before", "fuzzy_char_after"
    )
    before, after = F.col("fuzzy_char_before") == "Y", F.col("fuzzy_char_after") == "Y"
    whole = (F.col("fuzzy_char_before") == "N") & (F.col("fuzzy_char_after") == "N") & (F.length("piece") > 0)
    exact = rules.filter(whole).select(F.col("piece").alias(name), F.lit(2).alias("rank"), "days")
    fuzzy = rules.filter(before | after)
    lengths = fuzzy.agg(F.collect_set(F.length("piece")).alias("lengths"))
    size = F.length(name)
    cut = (
        dbs.select(name)
        .distinct()
        .withColumn("lengths", lengths.scalar())
        .select(name, F.explode("lengths").alias("n"))
        .filter((F.col("n") > 0) & (F.col("n") <= size))
        .select(name, "n", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("i"))
        .select(
            name,
            F.substring(F.col(name), F.col("i"), F.col("n")).alias("piece"),
            (F.col("i") == 1).alias("at_start"),
            (F.col("i") + F.col("n") == size + 1).alias("at_end"),
        )
    )
    fits = (before | F.col("at_start")) & (after | F.col("at_end"))
    matched = cut.join(F.broadcast(fuzzy), "piece").filter(fits).select(name, F.lit(3).alias("rank"), "days")
    best = blackout.unionByName(exact).unionByName(matched).groupBy(name).agg(F.min(F.struct("rank", "days")).alias("best"))
    return dbs.join(best, name, "left").withColumn("check_days", F.coalesce("best.days", F.lit(default))).drop("best")


def catalog_names(dbs: DataFrame) -> DataFrame:
    return dbs.select("name").distinct()
