"""Latest-row-per-key operators.

All of them reduce on the map side: rank filters get a partial group limit
before the shuffle, and ``max_by`` is a partial aggregate, so a key that holds a
third of the rows still sends only a handful of rows per map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import Band, columns, instant, ntz


def newest_first(*order: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in order]


def top_rows(df: DataFrame, keys, order: Sequence[Column], n: int = 1, ties: bool = False) -> DataFrame:
    """First ``n`` rows per key; with ``ties`` equal rows at the cut are all kept."""
    window = Window.partitionBy(*columns(keys)).orderBy(*order)
    number = F.rank() if ties else F.row_number()
    return df.withColumn("_rank", number.over(window)).filter(F.col("_rank") <= n).drop("_rank")


def latest_in_band(df: DataFrame, keys, ts: str, band: Band) -> DataFrame:
    """Latest row per key inside a time band; rows tied on the latest time are all kept.

    Only tied rows share a task: history is keyed by entity and time, so they are few.
    """
    return top_rows(df.filter(band.contains(ts)), keys, newest_first(ts), ties=True)


def latest_per_key(df: DataFrame, keys, ts: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Exactly one row per key: the newest, ties settled by ``tie_break`` descending."""
    return top_rows(df, keys, newest_first(ts, *tie_break))


def month_end_series(df: DataFrame, key: str, ts: str, value: str, as_of, days: int = 365) -> DataFrame:
    """Rows of the last observed day of each month, per key, within ``days`` of ``as_of``.

    A day of a busy key can hold very many rows, so the last days are worked out
    as a short list and joined back instead of ranking the rows of a month.
    """
    since = instant(as_of) - timedelta(days=days)
    rows = df.filter(F.col(ts) > ntz(since)).select(
        F.col(key),
        F.date_format(F.col(ts), "yyMM").alias("month_no"),
        F.to_date(ts).alias("space_date"),
        F.coalesce(F.col(value), F.lit(0)).alias(value),
    )
    last_days = rows.groupBy(key, "month_no").agg(F.max("space_date").alias("space_date")).select(key, "space_date")
    return rows.join(last_days, [key, "space_date"], "left_semi").select(key, "month_no", "space_date", value)
