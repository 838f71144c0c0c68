"""Order-dependent streams: change notices, counter deltas and the samples-ago panel.

The panel keeps the newest samples of a series as state, which needs no order of
arrival. Notices and deltas depend on what lies before a row. ``in_order`` keeps rows as
state until the watermark has passed them and then takes them in order of time; work
follows the batch, and timers act where no row arrives. Rows later than the watermark
allows are lost to it; where none may be, notices and deltas are computed from
history (see ``recomputed`` in ``operators``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fleetlens.operators.series_order import with_previous

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark) -> None:
    """Stateful processors need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def notices(history: DataFrame, failing: str, reminder_s: float) -> DataFrame:
    """Change-or-reminder notifications for ``(key, seq, ts, state)`` rows in any order.

    A row is CHANGED when its state differs from the one before. Within a failing run a REMINDER
    follows once more than ``reminder_s`` have passed since the last notice. Runs pass through a
    task one after the other, row by row; none is held.
    """
    rows = with_previous(history, "key", ["ts", "seq"], ["state"])
    rows = rows.withColumn("changed", F.col("prev_state").isNull() | (F.col("prev_state") != F.col("state")))
    changed = rows.filter("changed").select("key", "seq", "ts", "state", F.lit("CHANGED").alias("decision"))
    # A failing run begins at its change; its rows carry that moment.
    before = Window.partitionBy("key").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failing_rows = rows.withColumn("run", F.last(F.when(F.col("changed"), F.col("seq")), ignorenulls=True).over(before))
    failing_rows = failing_rows.filter((F.col("state") == failing) & F.col("ts").isNotNull()).select("key", "run", "seq", "ts", "state")
    first = F.row_number().over(Window.partitionBy("key", "run").orderBy("ts", "seq")) == 1
    step = int(reminder_s * 1_000_000)

    def reminders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = 0
        for batch in batches:
            picked = []
            for i, (begins, at) in enumerate(zip(batch.column("begins").to_pylist(), batch.column("us").to_pylist(), strict=True)):
                if begins:
                    told = at
                elif at > told + step:
                    picked.append(i)
                    told = at
            yield batch.select(columns).take(pa.array(picked, pa.int64()))

    columns = changed.columns[:-1]
    runs = failing_rows.withColumns({"begins": first, "us": F.unix_micros(F.col("ts").cast("timestamp"))}).sortWithinPartitions("key", "run", "ts", "seq")
    reminded = runs.mapInArrow(reminders, ", ".join(f"{c} {_type(changed, c)}" for c in columns))
    return changed.unionByName(reminded.withColumn("decision", F.lit("REMINDER")))


class InOrder(StatefulProcessor):
    """Rows of a key in order of event time.

    Rows wait as state until the watermark has passed them; a timer wakes the key when it passes
    the first of them, or the moment ``rule`` asked for. ``rule(last, rows, until)`` gets what it
    returned before (a tuple of ``last_schema``, or None), the rows to take next as (ts in
    microseconds, seq, value), and the time reached; it returns the new tuple, the rows to emit,
    and when to be woken at the latest (or None).
    """

    def __init__(self, rule, last_schema: str, value_type: str, names: list[str]):
        self.rule, self.last_schema, self.value_type, self.names = rule, last_schema, value_type, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"ts_us bigint, seq bigint, value {self.value_type}")
        self.last = handle.getValueState("last", self.last_schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = []
        for chunk in rows:
            new += zip(chunk["ts_us"].tolist(), chunk["seq"].tolist(), chunk["value"].tolist(), strict=True)
        self.waiting.appendList(new)
        self.wake(min(t for t, _, _ in new))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted(tuple(r) for r in self.waiting.get())
        due = [r for r in waiting if r[0] <= until]
        last, out, wake = self.rule(tuple(self.last.get()) if self.last.exists() else None, due, until)
        if last is not None:
            self.last.update(last)
        rest = waiting[len(due) :]
        if due:
            self.waiting.clear()
            if rest:
                self.waiting.put(rest)
        for t in ([rest[0][0]] if rest else []) + ([wake] if wake is not None else []):
            self.wake(t)
        if out:
            yield pd.DataFrame(out, columns=["ts_us", *self.names]).assign(key=key[0])[["key", "ts_us", *self.names]]

    def wake(self, us: int) -> None:
        self.handle.registerTimer(-(-us // 1000))

    def close(self) -> None:
        pass


def in_order(stream: DataFrame, delay: str, processor: InOrder, columns: str) -> DataFrame:
    """``(key, seq, ts, value)`` rows through ``processor``; rows may come up to ``delay`` late."""
    # Times as numbers, which mean the same whatever the session's time zone.
    timed = stream.withWatermark("ts", delay).withColumn("ts_us", F.unix_micros("ts"))
    out = timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor,
        outputStructType=f"key {_type(stream, 'key')}, ts_us long, {columns}",
        outputMode="append",
        timeMode="eventTime",
    )
    return out.withColumn("ts", F.timestamp_micros("ts_us")).drop("ts_us")


def reminders_due(failing: str, reminder_s: float):
    """Rule of ``InOrder``: CHANGED where the state differs, REMINDER each ``reminder_s`` in a failing run, rows or none."""
    step = int(reminder_s * 1_000_000)

    def rule(last, rows, until):
        state, told = last or (None, 0)
        out = []

        def remind(before: int) -> None:
            nonlocal told
            while state == failing and told + step < before:
                told += step
                out.append((told, state, "REMINDER"))

        for ts, _, value in rows:
            if value != state:
                remind(ts)
                state, told = value, ts
                out.append((ts, state, "CHANGED"))
        remind(until + 1)
        return (state, told) if state is not None else None, out, told + step if state == failing else None

    return rule


def notices_in_order(stream: DataFrame, delay: str, failing: str, reminder_s: float) -> DataFrame:
    """key, ts, state, decision: changes, and reminders when they fall due, also where no row arrives."""
    processor = InOrder(reminders_due(failing, reminder_s), "state string, told_us bigint", "string", ["state", "decision"])
    return in_order(stream, delay, processor, "state string, decision string")


def counted_up(last, rows, until):
    """Rule of ``InOrder``: difference from the row before; resets are skipped."""
    value, out = last[0] if last else None, []
    for ts, seq, new in rows:
        if value is not None and new >= value:
            out.append((ts, seq, new - value))
        value = new
    return (value,) if value is not None else None, out, None


def deltas_in_order(stream: DataFrame, delay: str) -> DataFrame:
    """key, ts, seq, delta of counter rows, with one value per key as state."""
    return in_order(stream, delay, InOrder(counted_up, "value bigint", "bigint", ["seq", "delta"]), "seq long, delta long")


class SamplesAgo(StatefulProcessor):
    """Keeps the newest ``depth`` samples of a series and emits them as one row per micro-batch."""

    def __init__(self, offsets: tuple[int, ...]):
        self.offsets = offsets
        self.depth = max(offsets) + 1

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "seq bigint, ts_us bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        tail = pd.DataFrame(kept, columns=["seq", "us", "value"])
        for chunk in rows:
            us = chunk["ts"].to_numpy("datetime64[us]").astype("int64")
            more = pd.DataFrame({"seq": chunk["seq"], "us": us, "value": chunk["value"]})
            tail = (more if tail.empty else pd.concat([tail, more])).sort_values(["us", "value", "seq"]).tail(self.depth)
        self.recent.put([(int(s), int(u), float(v)) for s, u, v in tail.itertuples(index=False)])
        newest = tail.iloc[::-1].reset_index(drop=True)
        row = {"key": [key[0]], "ts": [np.datetime64(int(newest["us"][0]), "us")], "now_value": [newest["value"][0]]}
        for k in self.offsets:
            row[f"back_{k}"] = [newest["value"][k] if k < len(newest) else None]
        yield pd.DataFrame(row)

    def close(self) -> None:
        pass


def samples_ago(stream: DataFrame, offsets: tuple[int, ...] = (1, 2, 3, 6, 9, 12)) -> DataFrame:
    """Latest panel per series after each micro-batch, from ``(key, seq, ts, value)`` rows."""
    lags = ", ".join(f"back_{k} double" for k in offsets)
    return stream.groupBy("key").transformWithStateInPandas(
        statefulProcessor=SamplesAgo(offsets),
        outputStructType=f"key {_type(stream, 'key')}, ts timestamp, now_value double, {lags}",
        outputMode="update",
        timeMode="none",
    )


def newest_panels(stored: DataFrame) -> DataFrame:
    """The panel of each series from the last micro-batch that held it; ``stored`` has a column ``batch``."""
    newest = stored.groupBy("key").agg(F.max("batch").alias("batch"))
    return stored.join(newest, ["key", "batch"], "left_semi").drop("batch")


def deltas(history: DataFrame) -> DataFrame:
    """Deltas of ``(key, seq, ts, value)`` counter rows in any order; resets are skipped."""
    rows = with_previous(history, "key", ["ts", "seq"], ["value"]).withColumn("delta", F.col("value") - F.col("prev_value"))
    return rows.filter("delta >= 0").select("key", "seq", "ts", "delta")


def _type(df: DataFrame, c: str) -> str:
    return df.schema[c].dataType.simpleString()


