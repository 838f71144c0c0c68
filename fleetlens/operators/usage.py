"""Product-usage audit: feature statistics mapped to products by longest version prefix.

Statistics can be concentrated on a few features or containers, so nothing here
ranks rows inside a feature or a container. The winning map entry is worked out
once per distinct (feature, version), and the newest sample once per container;
both are short lists that are joined back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import cat, columns, left_join_null_safe, version_sort_key

# Ordinal of each usage class and its reported name.
NO_PAST_USAGE = 1
NO_CURRENT_USAGE = 2
SUPPRESSED = 3
PAST_USAGE = 4
PAST_OR_CURRENT_USAGE = 5
CURRENT_USAGE = 6
CLASS_NAMES = {
    NO_PAST_USAGE: "NO_PAST_USAGE",
    NO_CURRENT_USAGE: "NO_CURRENT_USAGE",
    SUPPRESSED: "SUPPRESSED_DUE_TO_BUG",
    PAST_USAGE: "PAST_USAGE",
    PAST_OR_CURRENT_USAGE: "PAST_OR_CURRENT_USAGE",
    CURRENT_USAGE: "CURRENT_USAGE",
}
# Fixed patterns: what a feature's text must say for each condition code.
USED_NOW = {"C001": r"(?i)compression used: *TRUE", "C002": r"(?i)encryption used: *TRUE"}
USED_TIMES = {
    "C001": r"(?i)compression used:[ 0-9]*[1-9][ 0-9]*time",
    "C002": r"(?i)encryption used:[ 0-9]*[1-9][ 0-9]*time",
}
SHOWN_TEXT = {
    "C001": r"(?i)compression used:(.*?)(times|TRUE|FALSE)",
    "C002": r"(?i)encryption used:(.*?)(times|TRUE|FALSE)",
}


def feature_usage(
    stats: DataFrame, names: Sequence[str], patterns: Mapping[str, str], numeric_versions: bool = True, by=()
) -> DataFrame:
    """Used features at their highest version: listed by name, or whose text matches.

    ``numeric_versions=False`` compares versions as text. ``by`` tells databases apart.
    """
    by = columns(by)
    order = version_sort_key("version") if numeric_versions else F.col("version")
    highest = stats.groupBy(*by, "name").agg(F.max_by("version", order).alias("version"))
    wanted = F.col("name").isin(*names)
    for feature, pattern in patterns.items():
        wanted = wanted | ((F.col("name") == feature) & F.col("feature_info").like(pattern))
    return stats.filter((F.col("detected_usages") > 0) & wanted).join(highest, [*by, "name", "version"], "left_semi")


def _newest(stats: DataFrame, by: Sequence[str]) -> DataFrame:
    newest = F.max_by(
        F.struct("dbid", "version", "last_sample_date"), F.struct("last_sample_date", "dbid", "version")
    )
    return stats.groupBy(*by).agg(newest.alias("_newest"))


def latest_sample(stats: DataFrame, by="con_id", database=()) -> DataFrame:
    """Id, version and time of the newest sample per container, with a never-sampled remark.

    The remark is about a whole database; ``database`` names the columns that tell databases apart.
    """
    database = columns(database)
    by = list(dict.fromkeys([*database, *columns(by)]))
    never = stats.groupBy(*database).agg(
        (F.max("last_sample_date").isNull() & (F.max("total_samples") == 0)).alias("never")
    )
    newest = _newest(stats, by)
    newest = left_join_null_safe(newest, never, database) if database else newest.withColumn("never", never.scalar())
    return (
        newest
        .select(
            *by,
            F.col("_newest.dbid").alias("last_dbid"),
            F.col("_newest.version").alias("last_version"),
            F.col("_newest.last_sample_date").alias("last_sample_date"),
            "never",
        )
        .withColumn("remarks", F.when(F.col("never"), "NEVER SAMPLED !!!").otherwise(""))
        .drop("never")
    )


def mark_current(stats: DataFrame, by="con_id") -> DataFrame:
    """Y on rows whose id, version and sample second are those of the container's newest sample."""
    by = columns(by)
    marked = left_join_null_safe(stats, _newest(stats, by), by)
    second = lambda c: F.date_format(c, "yyyyMMddHHmmss")
    mine = F.struct(F.col("dbid"), F.col("version"), second(F.col("last_sample_date")).alias("at"))
    theirs = F.struct(
        F.col("_newest.dbid").alias("dbid"),
        F.col("_newest.version").alias("version"),
        second(F.col("_newest.last_sample_date")).alias("at"),
    )
    return marked.withColumn("current_entry", F.when(mine.eqNullSafe(theirs), "Y").otherwise("N")).drop("_newest")


def best_prefix_map(stats: DataFrame, product_map: DataFrame) -> DataFrame:
    """Rows mapped to products by the longest map version that is a prefix of their version.

    Never-sampled rows, entries marked INVALID and single-container conditions
    outside the root drop out.
    """
    sampled = stats.filter(F.coalesce("total_samples", F.lit(0)) > 0)
    pairs = sampled.select(F.col("name").alias("feature"), "version").distinct()
    matches = pairs.join(product_map, "feature").filter(F.col("version").startswith(F.col("mversion")))
    longest = matches.groupBy("feature", "version").agg(F.max("mversion").alias("mversion"))
    chosen = (
        matches.join(longest, ["feature", "version", "mversion"])
        .filter(F.coalesce(F.col("condition"), F.lit("-")) != "INVALID")
        .select(F.col("feature").alias("name"), "version", "product", "condition", "mversion")
    )
    mapped = sampled.join(chosen, ["name", "version"])
    elsewhere = (F.col("condition") == "C003") & ~F.col("con_id").isin(0, 1)
    return mapped.filter(~F.coalesce(elsewhere, F.lit(False)))


def usage_class() -> Column:
    """Ordinal usage class of a mapped row (needs ``current_entry``)."""
    condition, info = F.col("condition"), F.col("feature_info")

    def says(patterns: Mapping[str, str]) -> Column:
        out = F.lit(False)
        for code, pattern in patterns.items():
            out = out | ((condition == code) & F.coalesce(info.rlike(pattern), F.lit(False)))
        return out

    unconditional = F.coalesce(F.trim(condition), F.lit("")) == ""
    containers = (condition == "C003") & (F.col("con_id") == 1) & (F.col("aux_count") > 1)
    used = F.col("detected_usages") > 0
    live = (F.col("current_entry") == "Y") & (F.col("currently_used") == "TRUE")
    return (
        F.when(condition == "BUG", SUPPRESSED)
        .when(used & (unconditional | says(USED_NOW) | containers), F.when(live, CURRENT_USAGE).otherwise(PAST_USAGE))
        .when(used & says(USED_TIMES), F.when(live, PAST_OR_CURRENT_USAGE).otherwise(PAST_USAGE))
        .when(F.col("current_entry") == "Y", NO_CURRENT_USAGE)
        .otherwise(NO_PAST_USAGE)
    )


def classified_usage(stats: DataFrame, product_map: DataFrame, by=()) -> DataFrame:
    """Statistics with their product and ordinal usage class; ``by`` tells databases apart."""
    return best_prefix_map(mark_current(stats, [*columns(by), "con_id"]), product_map).withColumn("usage_class", usage_class())


def class_name(ordinal: Column, summary: bool = False) -> Column:
    """Reported name of an ordinal; a summary does not tell the two kinds of no usage apart."""
    names = {**CLASS_NAMES, NO_PAST_USAGE: "NO_USAGE", NO_CURRENT_USAGE: "NO_USAGE"} if summary else CLASS_NAMES
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ordinal), F.lit("UNKNOWN"))


def product_usage(classified: DataFrame, current_only: bool = False, by=()) -> DataFrame:
    """Highest usage class and usage dates per product, per container and over all containers.

    ``current_only`` leaves out past-only and undated usage. The total over all
    containers is left out when there are no real containers.
    """
    kept = [NO_CURRENT_USAGE, PAST_USAGE, PAST_OR_CURRENT_USAGE, CURRENT_USAGE]
    rows = classified
    if current_only:
        kept.remove(PAST_USAGE)
        rows = rows.filter(F.col("last_usage_date").isNotNull() | F.col("first_usage_date").isNotNull())
    rows = rows.filter(F.col("usage_class").isin(*kept)).withColumn("_container", F.col("con_id"))
    con, product = F.col("con_id"), F.col("product")
    own = [F.col(c) for c in columns(by)]
    grouped = rows.groupingSets([[*own, con, product], [*own, product]], *own, con, product).agg(
        F.grouping("con_id").cast("int").alias("gid"),
        F.max("_container").alias("_max_container"),
        F.max("con_name").alias("_con_name"),
        F.max("usage_class").alias("_class"),
        F.max("last_sample_date").alias("last_sample_date"),
        F.min("first_usage_date").alias("first_usage_date"),
        F.max("last_usage_date").alias("last_usage_date"),
    )
    useful = ~(F.col("_max_container").isin(-1, 0) & (F.col("gid") == 1))
    return grouped.filter(useful).select(
        *own,
        "gid",
        "con_id",
        F.when(F.col("gid") == 1, "--ALL--").otherwise(F.col("_con_name")).alias("con_name"),
        "product",
        class_name(F.col("_class"), summary=True).alias("usage"),
        "last_sample_date",
        "first_usage_date",
        "last_usage_date",
    )


def report_order(report: DataFrame) -> DataFrame:
    """Totals first, then containers; products that start with a dot come last."""
    dotted = F.when(F.col("product").startswith("."), 2).otherwise(1)
    return report.orderBy(F.desc("gid"), F.asc_nulls_last("con_id"), dotted, F.asc_nulls_last("product"))


def feature_detail(classified: DataFrame, dbid=None, used_only: bool = False, by=()) -> DataFrame:
    """One row per mapped feature with the text its condition looks at.

    ``dbid`` restricts the rows to one database, ``used_only`` to features that
    were ever used.
    """
    rows = classified.filter(F.col("usage_class") != NO_PAST_USAGE)
    if dbid is not None:
        rows = rows.filter(F.col("dbid") == dbid)
    if used_only:
        rows = rows.filter(F.col("last_usage_date").isNotNull() | (F.col("detected_usages") > 0))
    condition, info = F.col("condition"), F.col("feature_info")
    extra = (
        F.when(condition == "C001", F.regexp_substr(info, F.lit(SHOWN_TEXT["C001"])))
        .when(condition == "C002", F.regexp_substr(info, F.lit(SHOWN_TEXT["C002"])))
        .when(condition == "C003", cat("AUX_COUNT=", F.col("aux_count").cast("string")))
    )
    return rows.select(
        *columns(by),
        "con_id",
        "con_name",
        "product",
        F.col("name").alias("feature_being_used"),
        class_name(F.col("usage_class")).alias("usage"),
        "last_sample_date",
        "dbid",
        "version",
        "detected_usages",
        "total_samples",
        "currently_used",
        "first_usage_date",
        "last_usage_date",
        extra.alias("extra_feature_info"),
    )


def container_remarks(containers: DataFrame, current_con_id: int, is_container_db: bool) -> DataFrame:
    """What can be read from each container, and which one is connected."""
    shut = ~F.col("open_mode").like("READ%")
    here = F.col("con_id") == current_con_id
    cdb = F.lit(is_container_db)
    closed = "NOT OPEN! DBA_FEATURE_USAGE_STATISTICS is not accessible."
    remarks = (
        F.when(shut & here & (F.col("con_id") != 0), closed + " *CURRENT CONTAINER")
        .when(shut, closed)
        .when(here & cdb & ~F.col("con_id").isin(0, 1), "*CURRENT CONTAINER. Only data for this PDB will be listed.")
        .when(here & cdb & (F.col("con_id") == 1), "*CURRENT CONTAINER is CDB$ROOT. Information for all open PDBs will be listed.")
        .otherwise("")
    )
    return containers.withColumn("remarks", remarks)


def overall_card(instances: DataFrame, databases: DataFrame, banners: DataFrame, key: str = "dbid") -> DataFrame:
    """Instance, database and product banner per database of the fleet."""
    product = F.col("banner").like("Oracle%") | F.col("banner").like("Personal Oracle%")
    return (
        instances.select(key, "host_name", "instance_name", "version")
        .join(databases.select(key, F.col("name").alias("database_name"), "open_mode", "database_role", "created"), key)
        .join(banners.filter(product).select(key, "banner"), key)
    )


# Parameters that control or record the use of licensed features.
AUDITED_PARAMETERS = ("control_management_pack_access", "enable_ddl_logging")


def audited_parameters(params: DataFrame, by=()) -> DataFrame:
    """Values of the audited parameters; ``by`` tells databases apart."""
    return (
        params.filter(F.lower("name").isin(*AUDITED_PARAMETERS))
        .select(*columns(by), F.col("name").alias("parameter"), "value")
        .distinct()
    )
