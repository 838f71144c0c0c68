"""Table maintenance: upserts, conditional appends, retention and routing.

The functions that change a table's content return the new rows; ``upsert_table``
applies them to a Parquet table of the catalog, partitioned by date, and replaces only
the partitions a load touches.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.semantics import columns, midnight, ntz
from fleetlens.operators.latest import latest_per_key, newest_first, top_rows


def upsert(target: DataFrame, source: DataFrame, keys, update_cols: Sequence[str]) -> DataFrame:
    """Matched rows take ``update_cols`` from the source; unmatched source rows are inserted.

    A source that holds a key twice is refused (see :func:`dedupe_source`).
    """
    keys = columns(keys)
    old = target.select(*keys, F.struct(*[c for c in target.columns if c not in keys]).alias("_old"))
    row = F.struct(*[c for c in source.columns if c not in keys])
    new = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(row).alias("_new"))
    new = new.select(*keys, F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error("source repeats a key")).alias("_new"))
    both = old.join(new, keys, "full_outer")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def pick(c: str) -> Column:
        old_c = F.col("_old")[c]
        if c not in source.columns:
            return old_c.alias(c)
        new_c = F.col("_new")[c]
        if c in update_cols:
            return F.when(has_new, new_c).otherwise(old_c).alias(c)
        return F.when(has_old, old_c).otherwise(new_c).alias(c)

    return both.select(*[F.col(c) if c in keys else pick(c) for c in target.columns])


def update_matching(target: DataFrame, source: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """Matched rows take ``cols`` from the source; nothing is inserted.

    A source that holds a key of the target twice is refused, as in :func:`upsert`.
    """
    keys = columns(keys)
    new = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*cols)).alias("_new"))
    new = new.select(*keys, F.when(F.col("_n") == 1, F.col("_new")).otherwise(F.raise_error("source repeats a key")).alias("_new"))
    both = target.join(new, keys, "left")
    return both.select(
        *[
            F.when(F.col("_new").isNotNull(), F.col("_new")[c]).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
            for c in target.columns
        ]
    )


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def append_changed(target: DataFrame, source: DataFrame, keys, cols: Sequence[str], ts: str, tie_break=()) -> DataFrame:
    """Source rows that differ from the latest stored row of their key, or have none."""
    keys = columns(keys)
    stored = latest_per_key(target, keys, ts, tie_break).select(*keys, F.struct(*cols).alias("_stored"))
    same = F.col("_stored").eqNullSafe(F.struct(*[F.col(c) for c in cols]))
    return source.join(stored, keys, "left").filter(F.col("_stored").isNull() | ~same).drop("_stored")


def purge(target: DataFrame, ts: str, as_of, days: int = 42, only: Column | None = None) -> DataFrame:
    """Rows that survive retention; ``only`` limits the purge to some rows."""
    old = F.col(ts) < ntz(midnight(as_of, -days))
    doomed = old if only is None else old & only
    return target.filter(~F.coalesce(doomed, F.lit(False)))


def open_alert_once(alerts: DataFrame, candidates: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Candidates to insert: the first per key, and only where no alert is open."""
    fresh = candidates.join(alerts.select(key).distinct(), key, "left_anti")
    return top_rows(fresh, key, [F.asc_nulls_last(c) for c in order])


def route_by_weekday(df: DataFrame, ts: str, days: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Every row for the monthly table, and the rows of the chosen weekdays for the main table.

    ``days`` are three-letter English names such as 'Mon'.
    """
    chosen = F.date_format(F.col(ts), "EEE").isin(*days)
    return df, df.filter(chosen)


def dedupe_source(df: DataFrame, keys=None, prefer: Sequence[str] = ()) -> DataFrame:
    """Distinct rows, or one row per key: the one with the highest ``prefer`` columns."""
    if keys is None:
        return df.distinct()
    return top_rows(df, keys, newest_first(*prefer))


# --- tables on disk -------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """A folder that driver and executors share: ``spark.checkpoint.dir``, else one in the warehouse.

    On a cluster a warehouse on the driver's own disk is no such folder and is refused.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        warehouse = spark.conf.get("spark.sql.warehouse.dir", None) or ""
        own_disk = warehouse.startswith(("file:", "/")) or "://" not in warehouse
        if not warehouse or (own_disk and not context.master.startswith("local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
        folder = f"{warehouse.rstrip('/')}/scratch"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def write_clustered(df: DataFrame, table: str, keys, ts: str, buckets: int, path: str | None = None) -> None:
    """History as a catalog table bucketed by entity and sorted by entity and time.

    Operators that group by these keys (and maybe more) read it without a shuffle. ``buckets``
    should give files of some hundred megabytes; a table keeps the number it is created with.
    """
    keys = columns(keys)
    # One file per bucket: rows are dealt as the buckets are, in this write and in every later one.
    writer = df.repartition(buckets, *keys).write.mode("append").format("parquet").bucketBy(buckets, *keys).sortBy(*keys, ts)
    (writer.option("path", path) if path else writer).saveAsTable(table)


def settled(df: DataFrame, name: str) -> DataFrame:
    """The rows, stored in the shared folder and read back: short lineage, the same rows for every reader."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


HISTORY_DAY = "history_day"


def write_history(df: DataFrame, path: str, ts: str, keys, mode: str = "append") -> None:
    """History partitioned by day and sorted by entity and time inside each file.

    The rebalance hint lets adaptive execution split a crowded day over several
    tasks and merge thin ones, so files come out near the advisory size.
    """
    rows = df.withColumn(HISTORY_DAY, F.to_date(ts)).hint("rebalance", HISTORY_DAY)
    rows = rows.sortWithinPartitions(HISTORY_DAY, *columns(keys), ts)
    rows.write.mode(mode).partitionBy(HISTORY_DAY).parquet(path)


def read_history(spark: SparkSession, path: str, ts: str, since=None) -> DataFrame:
    """History from ``since`` on; older days are not even listed for reading."""
    rows = spark.read.parquet(path)
    if since is not None:
        rows = rows.filter((F.col(HISTORY_DAY) >= F.lit(midnight(since).date())) & (F.col(ts) >= ntz(since)))
    return rows.drop(HISTORY_DAY)


def upsert_table(spark: SparkSession, table: str, source: DataFrame, keys, update_cols: Sequence[str], partition_by: str) -> None:
    """Upsert into a partitioned Parquet table of the catalog; untouched partitions are neither read nor written.

    The new content of the touched partitions goes to folders of its own. Only when all of it is
    written are the partitions' locations switched, so readers see the old table until then, and
    a failure leaves it as it was. The switch is one catalog change for each partition; a failure
    among them is mended by running the same upsert again, which changes nothing where it was done.

    ``partition_by`` must be one of the keys. Its distinct values in one load (days) are collected
    to prune the read.
    """
    if partition_by not in columns(keys):
        raise ValueError(f"{partition_by} must be part of the key")
    touched = [r[0] for r in source.select(partition_by).distinct().collect()]
    target = spark.table(table)
    new = upsert(target.filter(F.col(partition_by).isin(touched)), source, keys, update_cols)
    folder = f"{shared_folder(spark).rstrip('/')}/{table}-{uuid.uuid4().hex}"
    new.select(*target.columns).write.partitionBy(partition_by).parquet(folder)
    switch_partitions(spark, table, partition_by, folder, touched)


def switch_partitions(spark: SparkSession, table: str, column: str, folder: str, values: Sequence) -> None:
    """Let partitions of a catalog table lie in the folder that holds them as ``column=value``."""
    known = {r[0].split("=", 1)[1] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()}
    for value in map(str, values):
        spec, place = f"PARTITION ({column} = '{value}')", f"{folder}/{column}={value}"
        if value in known:
            spark.sql(f"ALTER TABLE {table} {spec} SET LOCATION '{place}'")
        else:
            spark.sql(f"ALTER TABLE {table} ADD IF NOT EXISTS {spec} LOCATION '{place}'")
    spark.catalog.refreshTable(table)


def drop_old_partitions(spark: SparkSession, table: str, column: str, as_of, days: int = 42) -> list[str]:
    """Retention on a catalog table partitioned by date: drops partitions, rewrites nothing."""
    limit = midnight(as_of, -days).date().isoformat()
    names = [r[0] for r in spark.sql(f"SHOW PARTITIONS {table}").collect()]
    old = sorted(d for d in (n.split("=", 1)[1] for n in names) if d < limit)
    for day in old:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({column} = '{day}')")
    return old
