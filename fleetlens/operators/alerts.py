"""Classification of report lines and notification decisions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import columns, instant, ntz, seconds_between

# Fixed patterns: the bar of a container that is at least 90 percent full.
FULL_BAR = r"(?i)\[X{18}--\]$|\[X{19}-\]$| \[X{20}\]$"
TEMPORARY_OR_UNDO = r"\((u|t)\)"
BACKUP_FAILURE = r"(?i)backup failure"
ANY_ERROR = r"(?i)ERROR|FAIL"
LOG_ERRORS = r"(?i)ORA-|TNS-|TWO-TASK|FAILED"
NOT_OK = r"NOT OK|errno|ERROR|Error"


def _quiet_backups(lines: DataFrame, target: str, line: str) -> DataFrame:
    """Targets whose own report says that they have no backup alerts."""
    said = F.contains(F.lower(line), F.concat(F.lit("no rman alerts for "), F.lower(target)))
    return lines.filter(said).select(target).distinct().withColumn("_quiet", F.lit(True))


def classify_lines(lines: DataFrame, target: str = "target", line: str = "line") -> DataFrame:
    """Level of each report line by the first rule that matches, and its text as shown.

    The list of targets without backup alerts is worked out first and joined, so
    a backup-failure line can be downgraded without gathering a target's lines.
    """
    text = F.col(line)
    full = text.rlike(FULL_BAR)
    ladder: list[tuple[Column, str]] = [
        (text.contains("+") & text.contains("Summary"), "HEADING"),
        (text.contains("successes and failures"), "NEUTRAL"),
        (text.contains("WARNING"), "WARNING"),
        (text.contains("NOARCHIVELOG"), "WARNING"),
        (text.rlike(TEMPORARY_OR_UNDO) & full, "WARNING"),
        (full, "ERROR"),
        (F.col("_quiet") & text.rlike(BACKUP_FAILURE), "WARNING"),
        (text.rlike(ANY_ERROR), "ERROR"),
    ]
    level = F.when(*ladder[0])
    for test, name in ladder[1:]:
        level = level.when(test, name)
    softened = text.rlike(TEMPORARY_OR_UNDO) & full & (F.col("level") == "WARNING")
    return (
        lines.join(_quiet_backups(lines, target, line), target, "left")
        .withColumn("_quiet", F.coalesce("_quiet", F.lit(False)))
        .withColumn("level", level.otherwise("NEUTRAL"))
        .withColumn("shown", F.when(softened, F.regexp_replace(line, "ERROR", "WARNING")).otherwise(text))
        .drop("_quiet")
    )


def severity_counts(classified: DataFrame, target: str = "target") -> DataFrame:
    return classified.groupBy(target).agg(
        *[F.count_if(F.col("level") == lv).alias(f"{lv.lower()}_count") for lv in ("WARNING", "ERROR")]
    )


def follow_ups(classified: DataFrame, target: str = "target", line: str = "line", phrase: str = "ERROR - tablespace alerts") -> DataFrame:
    """Targets whose container check failed, to be listed in full."""
    return classified.filter(F.col(line).contains(phrase)).select(target).distinct()


def follow_up_usage(
    classified: DataFrame, usage: DataFrame, target: str = "target", owner: str = "database_name", min_pct: float = 90
) -> DataFrame:
    """The fuller containers of every target whose container check failed."""
    wanted = follow_ups(classified, target).select(F.col(target).alias(owner))
    return usage.filter(F.col("pct_used") > min_pct).join(wanted, owner, "left_semi")


def extract_severe(classified: DataFrame, levels: Sequence[str] = ("HEADING", "WARNING", "ERROR")) -> DataFrame:
    return classified.filter(F.col("level").isin(*levels))


def _normalised(lines: DataFrame, target: str, line: str) -> DataFrame:
    """Report lines without timing: 'completed' lines dropped, text cut at the first bracket."""
    return lines.filter(~F.col(line).contains("completed")).select(
        F.col(target).alias("target"), F.substring_index(line, "(", 1).alias("line")
    )


def notify_on_change(
    current: DataFrame,
    previous: DataFrame,
    last_notified: DataFrame,
    as_of,
    *,
    reminder: timedelta = timedelta(minutes=60),
    target: str = "target",
    line: str = "line",
    error: str = "is_error",
    remind_only_if_error: bool = True,
) -> DataFrame:
    """CHANGED, REMINDER or NONE per target.

    Reports are compared as bags of normalised lines: every (target, line) is
    counted with its sign, so a target of any size is compared piecewise.
    ``last_notified`` has ``target`` and ``notified_at``; ``current`` flags error
    lines in ``error``.
    """
    signed = (
        _normalised(current, target, line)
        .withColumn("sign", F.lit(1))
        .unionByName(_normalised(previous, target, line).withColumn("sign", F.lit(-1)))
    )
    changed = (
        signed.groupBy("target", "line")
        .agg(F.sum("sign").alias("net"))
        .groupBy("target")
        .agg(F.max(F.col("net") != 0).alias("changed"))
    )
    failing = current.groupBy(F.col(target).alias("target")).agg(F.max(error).alias("in_error"))
    overdue = F.col("notified_at") < ntz(instant(as_of) - reminder)
    remind = overdue & F.col("in_error") if remind_only_if_error else overdue
    return (
        changed.join(failing, "target", "full_outer")
        .join(last_notified.select("target", "notified_at"), "target", "left")
        .withColumn("in_error", F.coalesce("in_error", F.lit(False)))
        .select(
            "target",
            "in_error",
            F.when(F.col("changed"), "CHANGED")
            .when(F.coalesce(remind, F.lit(False)), "REMINDER")
            .otherwise("NONE")
            .alias("decision"),
        )
    )


def slow_runs(runs: DataFrame, limit_s: float = 60) -> DataFrame:
    """Elapsed seconds of each run, and whether it took longer than the limit."""
    elapsed = seconds_between(F.col("ended"), F.col("started"))
    return runs.withColumn("elapsed_seconds", elapsed).withColumn(
        "level", F.when(F.col("elapsed_seconds") > limit_s, "WARNING").otherwise("OK")
    )


SEVERITY = {"OK": 0, "SKIPPED": 0, "WARNING": 1, "ERROR": 2}


def probe_status(results: DataFrame, skips: DataFrame, timeout_s: float = 10, target: str = "target") -> DataFrame:
    """Status per probed target: skipped, unreachable, slow, login failed or OK."""
    reasons = skips.groupBy(target).agg(F.min("reason").alias("skip_reason"))
    skipped = F.col("skip_reason").isNotNull()
    status = (
        F.when(skipped, "SKIPPED")
        .when(~F.col("ping_ok"), "ERROR")
        .when(F.col("ping_ms") > timeout_s * 1000, "WARNING")
        .when(~F.col("login_ok"), "ERROR")
        .otherwise("OK")
    )
    note = (
        F.when(skipped, F.concat(F.lit("Intentionally skipped ("), "skip_reason", F.lit(")")))
        .when(~F.col("ping_ok") | (F.col("ping_ms") > timeout_s * 1000), "Unable to tnsping")
        .when(~F.col("login_ok"), "Failed to connect")
        .otherwise("Looks OK")
    )
    return results.join(reasons, target, "left").select(target, status.alias("status"), note.alias("note"))


def report_status(statuses: DataFrame, by=()) -> DataFrame:
    """Worst status of a report."""
    rank = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    worst = statuses.groupBy(*columns(by)).agg(F.max(rank[F.col("status")]).alias("_worst"))
    name = F.when(F.col("_worst") == 2, "ERROR").when(F.col("_worst") == 1, "WARNING").otherwise("OK")
    return worst.select(*columns(by), name.alias("status"))


def text_verdict(lines: DataFrame, target: str = "target", line: str = "line", failing: str = NOT_OK, marked: str = "####") -> DataFrame:
    """Failing and marked line counts per target, and the verdict they give."""
    bad = F.col(line).rlike(failing)
    return (
        lines.groupBy(target)
        .agg(
            F.count_if(bad).alias("failing_lines"),
            F.count_if(~bad & F.col(line).contains(marked)).alias("marked_lines"),
            F.count("*").alias("lines"),
        )
        .withColumn("verdict", F.when(F.col("failing_lines") > 0, "NOT OK").otherwise("OK"))
    )


def error_histogram(lines: DataFrame, line: str = "line", pattern: str = LOG_ERRORS, ignore: str = "(WARN)") -> DataFrame:
    """How often each distinct error line occurs, warnings left out."""
    hits = lines.filter(F.col(line).rlike(pattern) & ~F.col(line).contains(ignore))
    return hits.groupBy(line).agg(F.count("*").alias("occurrences"))


def error_sketches(lines: DataFrame, by, line: str = "line", pattern: str = LOG_ERRORS, ignore: str = "(WARN)", tracked: int = 10_000) -> DataFrame:
    """One sketch of the error lines of each ``by`` (a day, say): how often the frequent ones occur.

    A sketch has a fixed size and can be stored. Counts are exact while a sketch has met fewer than
    ``tracked`` distinct lines; beyond that they are estimates that fall short by no more than a
    fixed share of all lines, which shrinks as ``tracked`` grows.
    """
    hits = lines.filter(F.col(line).rlike(pattern) & ~F.col(line).contains(ignore))
    return hits.groupBy(*columns(by)).agg(F.expr(f"approx_top_k_accumulate(`{line}`, {tracked})").alias("sketch"))


def most_frequent(sketches: DataFrame, k: int, by=(), tracked: int = 10_000) -> DataFrame:
    """The ``k`` most frequent lines of the merged sketches, per ``by`` if given: line, occurrences.

    Sketches of days merge to that of a week as if its lines had been sketched at once.
    """
    by = columns(by)
    merged = sketches.groupBy(*by).agg(F.expr(f"approx_top_k_combine(sketch, {tracked})").alias("sketch"))
    top = F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("top")
    return merged.select(*by, top).select(*by, F.col("top.item").alias("line"), F.col("top.count").alias("occurrences"))
