"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# White space of the contracts: the blank and the controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one in the warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/scratch").rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder, read back: cuts the lineage and outlives executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces_of_a_group(spark: SparkSession) -> int:
    """Into how many pieces a group that may hold most rows is dealt; follows the cluster's partitions."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column | str, folds: int = 4) -> Column:
    """The fold that models never learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 2, F.lit(False))


def running_total(df: DataFrame, keys: list[str], chunk: str, order: list[Column], value: str, out: str) -> DataFrame:
    """Sum of ``value`` over the rows of a key that come before, in the order (chunk, order).

    Chunks of a key are summed first and their few totals are run through; no task sees a whole key.
    Without keys, chunks are those of ``in_order``.
    """
    by_chunk = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*keys, chunk)
        .agg(F.sum(value).alias("_total"))
        .withColumn("_start", F.coalesce(F.sum("_total").over(by_chunk), F.lit(0)))
        .drop("_total")
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_inner", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return inner.join(starts.hint("merge"), [*keys, chunk]).withColumn(out, F.col("_start") + F.col("_inner")).drop("_start", "_inner")


def in_order(df: DataFrame, *order: Column, name: str = "in-order") -> DataFrame:
    """The rows dealt to ranges of the order, with the number of the range as ``chunk``: for running sums over all rows."""
    return written(df.repartitionByRange(*order).withColumn("chunk", F.spark_partition_id()), name)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the rows do not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
