"""Structured Streaming forms of the polled operators.

No result depends on how the input is cut into files and micro-batches, or on the
order in which rows arrive. Windows close by a watermark; what comes later still is
kept in a table of its own and merged by a repair step, so that no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.semantics import columns, ntz
from fleetlens.operators.inventory import rows_in_blackout
from fleetlens.sinks.tables import dedupe_source, upsert_table


def zoned(stream: DataFrame, ts: str) -> DataFrame:
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


# --- windows: partial states per micro-batch, merged when they are read ------------------


def stored_by_batch(path: str, prepare: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores what ``prepare`` makes of a micro-batch under its number.

    A replayed batch overwrites itself, so nothing counts twice.
    """

    def apply(batch: DataFrame, number: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return apply


@dataclass(frozen=True)
class Windows:
    """Aggregates per series and window that are exact in any order of arrival and under any cut into batches.

    ``partial`` reduces one micro-batch to states; ``merged`` adds states up to results.
    """

    keys: list[str]
    ts: str
    length: str
    slide: str | None
    states: dict[str, Column]
    merges: dict[str, Column]
    results: dict[str, Column]

    def partial(self, batch: DataFrame) -> DataFrame:
        window = F.window(F.col(self.ts).cast("timestamp_ntz"), self.length, self.slide)
        grouped = batch.groupBy(*self.keys, window).agg(*[c.alias(n) for n, c in self.states.items()])
        return grouped.select(*self.keys, F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *self.states)

    def merged_states(self, stored: DataFrame) -> DataFrame:
        rows = stored.groupBy(*self.keys, "window_start", "window_end").agg(*[c.alias(n) for n, c in self.merges.items()])
        return rows.select(*self.keys, "window_start", "window_end", *self.states)

    def merged(self, stored: DataFrame) -> DataFrame:
        rows = self.merged_states(stored)
        return rows.select(*self.keys, "window_start", "window_end", *[c.alias(n) for n, c in self.results.items()])


@dataclass(frozen=True)
class WindowTables:
    """Where a stream of windows keeps its states; each micro-batch writes under its own number.

    ``open``: partial states, by the day their window ends; ``closed``: states of windows that the
    watermark has passed, each written once; ``late``: partial states of rows that came after
    that; ``progress``: newest event time up to each batch, from which the watermark follows.
    """

    windows: Windows
    path: str
    delay: str

    def store(self, batch: DataFrame, number: int) -> None:
        """``foreachBatch`` function; a replayed batch overwrites what it wrote.

        A batch reads the states of windows still open, and drops the days whose windows were all
        closed before it began, so what it reads does not grow with the stream.
        """
        spark = batch.sparkSession
        partial = self.windows.partial(batch).persist()
        try:
            before = self.newest(spark, number - 1)
            newest = batch.agg(F.max(F.col(self.windows.ts).cast("timestamp_ntz")).alias("newest"))
            newest = newest.select(F.greatest("newest", _moment(before)).alias("newest"))
            newest.write.mode("overwrite").parquet(f"{self.path}/progress/batch={number}")
            before, now = self.watermark(spark, number - 1), self.watermark(spark, number)
            late = F.coalesce(F.col("window_end") <= _moment(before), F.lit(False))
            partial.filter(late).write.mode("overwrite").parquet(f"{self.path}/late/batch={number}")
            timely = partial.filter(~late).withColumns({"end_day": F.to_date("window_end"), "batch": F.lit(number).cast("long")})
            writer = timely.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            writer.partitionBy("end_day", "batch").parquet(f"{self.path}/open")
            closing = self.windows.merged_states(self.still_open(partial, before, number).filter(F.col("window_end") <= _moment(now)))
            # Sums keep the type of their parts, so that states of all tables can be merged.
            closing = closing.select(*[F.col(f.name).cast(f.dataType) for f in partial.schema])
            closing.write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
            if before is not None:
                drop_days(spark, f"{self.path}/open", "end_day", before.date())
        finally:
            partial.unpersist()

    def newest(self, spark, number: int):
        """Newest event time up to a batch (null before the first)."""
        if number < 0:
            return None
        return spark.read.schema("newest timestamp_ntz").parquet(f"{self.path}/progress/batch={number}").first()["newest"]

    def watermark(self, spark, number: int):
        """Event time up to which windows are closed after a batch."""
        newest = self.newest(spark, number)
        return None if newest is None else spark.range(1).select(_moment(newest) - F.expr(f"INTERVAL {self.delay}")).first()[0]

    def still_open(self, like: DataFrame, watermark, upto: int) -> DataFrame:
        """Partial states of batches up to ``upto`` whose windows end after the watermark."""
        rows = like.sparkSession.read.schema(f"{_fields(like)}, batch long, end_day date").parquet(f"{self.path}/open")
        rows = rows.filter(F.col("batch") <= upto)
        if watermark is not None:
            rows = rows.filter((F.col("end_day") >= F.lit(watermark.date())) & (F.col("window_end") > _moment(watermark)))
        return rows.select(*like.columns)

    def part(self, spark, name: str) -> DataFrame:
        """The states stored under ``closed`` or ``late``, with their batch."""
        return spark.read.parquet(f"{self.path}/{name}")

    def closed(self, spark) -> DataFrame:
        """Closed windows as they were when they closed."""
        return self.windows.merged(self.part(spark, "closed").drop("batch"))

    def current(self, spark) -> DataFrame:
        """All windows: closed ones repaired by what came late, and those still open."""
        closed, late = self.part(spark, "closed").drop("batch"), self.part(spark, "late").drop("batch")
        last = spark.read.schema("batch long").parquet(f"{self.path}/progress").agg(F.max("batch")).first()[0]
        rest = self.still_open(closed, self.watermark(spark, last), last)
        return self.windows.merged(closed.unionByName(late).unionByName(rest))


def _moment(value) -> Column:
    return F.lit(None).cast("timestamp_ntz") if value is None else ntz(value)


def drop_days(spark, path: str, column: str, before) -> None:
    """Remove the day folders of a partitioned path that lie before a day."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith(f"{column}=") and name.split("=", 1)[1] < before.isoformat():
            files.delete(status.getPath(), True)


def sliding_averages(keys, ts: str, value: str, length: str = "1 hour", slide: str | None = "15 minutes") -> Windows:
    """Mean and sample count per series and sliding window."""
    return Windows(
        columns(keys), ts, length, slide,
        states={"samples": F.count(value), "total": F.sum(value)},
        merges={"samples": F.sum("samples"), "total": F.sum("total")},
        results={"samples": F.col("samples"), "mean_value": _mean()},
    )


def windowed_high_water(keys, ts: str, value: str, length: str = "1 day", tie_break: Sequence[str] = ()) -> Windows:
    """First sample that reached the maximum of its window, per series."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    best = F.max_by(F.struct(value, ts, *tie_break), F.struct(F.col(value), F.lit(0) - micros, *tie_break))
    stored = [F.col("best")[c] for c in (value, ts, *tie_break)]
    again = F.struct(stored[0], F.lit(0) - F.unix_micros(stored[1].cast("timestamp")), *stored[2:])
    return Windows(
        columns(keys), ts, length, None,
        states={"best": best},
        merges={"best": F.max_by("best", again)},
        results={c: F.col("best")[c] for c in (value, ts, *tie_break)},
    )


def windowed_rollup(keys, ts: str, value: str, length: str = "1 hour") -> Windows:
    """Count, mean, minimum and maximum per series and tumbling window."""
    return Windows(
        columns(keys), ts, length, None,
        states={"samples": F.count(value), "total": F.sum(value), "min_value": F.min(value), "max_value": F.max(value)},
        merges={"samples": F.sum("samples"), "total": F.sum("total"), "min_value": F.min("min_value"), "max_value": F.max("max_value")},
        results={"samples": F.col("samples"), "mean_value": _mean(), "min_value": F.col("min_value"), "max_value": F.col("max_value")},
    )


def _mean() -> Column:
    return F.try_divide(F.col("total").cast("double"), F.col("samples").cast("double"))


# --- tables kept by a stream ------------------------------------------------------------

DAY = "ingest_day"


def ingest_once(path: str, keys, ts: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that appends snapshots not yet stored, however late they come.

    Repeats of a key and time are dropped within the batch and against the stored days it touches;
    a replayed batch adds nothing.
    """
    keys = list(dict.fromkeys([*columns(keys), ts]))

    def apply(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates(keys).withColumn(DAY, F.to_date(ts)).persist()
        try:
            days = [r[0] for r in rows.select(DAY).distinct().collect()]
            if not days:
                return
            new = rows
            if exists(batch.sparkSession, path):
                stored = batch.sparkSession.read.schema(rows.schema).parquet(path)
                new = rows.join(stored.filter(F.col(DAY).isin(days)).select(*keys), keys, "left_anti")
            new.write.mode("append").partitionBy(DAY).parquet(path)
        finally:
            rows.unpersist()

    return apply


def exists(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def recomputed(history: str, result: str, key: str, compute: Callable[[DataFrame], DataFrame], buckets: int = 32) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function for results that depend on the order of a series' samples.

    Rows go into a history by bucket of their key; the buckets a batch touches are computed anew by
    the batch form, so that late rows change what they should and replays change nothing. At most
    ``buckets`` numbers reach the driver.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        try:
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]
            if not touched:
                return
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{history}/batch={number}")
            known = spark.read.schema(f"{_fields(rows)}, batch long").parquet(history).drop("batch").filter(F.col("bucket").isin(touched))
            new = compute(known.drop("bucket")).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
            new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(result)
        finally:
            rows.unpersist()

    return apply


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def upsert_batches(table: str, keys, update_cols: Sequence[str], partition_by: str, newest: Sequence[str]):
    """``foreachBatch`` function that upserts each micro-batch; replaying a batch changes nothing.

    Of several versions of a key in one batch, the one with the highest ``newest`` columns counts.
    """

    def apply(batch: DataFrame, _: int) -> None:
        # The batch is read twice: for the days it touches and for the upsert.
        rows = dedupe_source(batch, columns(keys), newest).persist()
        try:
            if not rows.isEmpty():
                upsert_table(batch.sparkSession, table, rows, keys, update_cols, partition_by)
        finally:
            rows.unpersist()

    return apply


def drain(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Hands everything available to ``apply``, micro-batch by micro-batch, and stops."""
    writer = stream.writeStream.outputMode(mode).foreachBatch(apply).option("checkpointLocation", checkpoint)
    writer.trigger(availableNow=True).start().awaitTermination()


def suppress_blackouts(path: str, rules: Callable[[], DataFrame], ts: str) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that stores the alerts outside the blackouts of their database.

    ``rules`` reads the rules; it is called for each micro-batch, so that a blackout entered while
    the stream runs counts from the next batch on.
    """
    return stored_by_batch(path, lambda batch: rows_in_blackout(batch, rules(), ts, inside=False))


def write_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available into a Parquet table and stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
