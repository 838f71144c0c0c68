"""Predecessor of every row in a series, with no task holding a whole hot series.

A plain ``lag`` window sends all rows of one key to one task. Here rows are dealt to
ranges of (key, order), which split a hot series, and even a hot instant, as evenly as
any other rows. Within a range the predecessor is a window. Across ranges only one row
is missing: the first of a range follows the last of the range before. The last rows of
all ranges are a table with one row per range, which is shifted by one and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import columns
from fleetlens.sinks.tables import settled


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of the rows has them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def in_ranges(df: DataFrame, line: Sequence[str], part: str, ranges: int | None = None) -> DataFrame:
    """The rows in ranges of the columns of ``line``, numbered by ``part``.

    Ranges are bounded by sampled rows, so a second run could draw other bounds; the rows are
    stored, and all that follows reads the same ranges.
    """
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartitionByRange(ranges, *[F.asc_nulls_first(c) for c in line]).withColumn(part, F.spark_partition_id())
    return settled(dealt, "ranges")


def with_previous(
    df: DataFrame,
    keys: str | Sequence[str],
    order: str | Sequence[str],
    carry: Sequence[str],
    *,
    prefix: str = "prev_",
    ranges: int | None = None,
) -> DataFrame:
    """Add ``prev_<c>`` for each carried column: its value on the row before.

    ``order`` must be a total order of non-null values within a key (end it with a unique
    column). A null key is a series of its own. ``ranges`` defaults to the session's number of
    shuffle partitions.
    """
    keys, order = columns(keys), columns(order)
    part, before, last, rn = free_names(df, "_part", "_before", "_last", "_rn")
    rows = in_ranges(df, [*keys, *order], part, ranges)

    # One row per range. Structs compare as the ranges do: field by field, null first.
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    value = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)])
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ends = rows.groupBy(part).agg(F.max_by(F.struct(key.alias("key"), value.alias("value")), F.struct(key, place)).alias(last))
    handed = ends.select(part, F.lag(last).over(Window.orderBy(part)).alias(before))

    inside = Window.partitionBy(part, *keys).orderBy(*[F.asc_nulls_first(c) for c in order])
    lagged = [F.lag(c).over(inside).alias(prefix + c) for c in carry]
    joined = rows.select("*", *lagged, F.row_number().over(inside).alias(rn)).join(handed, part, "left")
    # Only the first series of a range can go on from the range before.
    goes_on = (F.col(rn) == 1) & F.col(before)["key"].eqNullSafe(key)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[F.when(goes_on, F.col(before)["value"][f"c{i}"]).otherwise(F.col(prefix + c)).alias(prefix + c) for i, c in enumerate(carry)],
    )
