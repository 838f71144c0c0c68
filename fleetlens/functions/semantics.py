"""Null, date and text rules decided once for the whole library.

Every operator takes an explicit ``as_of``; nothing here reads the clock. Time
columns are TIMESTAMP_NTZ, and bounds are computed in Python so that they reach
the scan as literals and can be pushed down.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def columns(cs: str | Iterable[str]) -> list[str]:
    return [cs] if isinstance(cs, str) else list(cs)


# --- time ------------------------------------------------------------------


def instant(value: datetime | str) -> datetime:
    """``as_of`` as a Python datetime (ISO text accepted)."""
    return value if isinstance(value, datetime) else datetime.fromisoformat(value)


def midnight(value: datetime | str, days: int = 0) -> datetime:
    """Start of the day ``days`` away from ``value``'s own day."""
    d = instant(value)
    return datetime(d.year, d.month, d.day) + timedelta(days=days)


def ntz(value: datetime | str) -> Column:
    """Zone-free timestamp literal; folds to a constant before planning."""
    return F.lit(instant(value).isoformat(sep=" ")).cast("timestamp_ntz")


def micros_between(later: Column, earlier: Column) -> Column:
    """Exact microseconds from ``earlier`` to ``later``, free of any time zone."""
    gap = later - earlier
    day, hour, minute, second = (F.extract(F.lit(p), gap) for p in ("DAY", "HOUR", "MINUTE", "SECOND"))
    whole = day.cast("long") * 86400 + hour.cast("long") * 3600 + minute.cast("long") * 60
    return whole * 1000000 + (second * 1000000).cast("long")


def seconds_between(later: Column, earlier: Column) -> Column:
    return micros_between(later, earlier) / F.lit(1000000.0)


def epoch_micros(ts: Column) -> Column:
    return micros_between(ts.cast("timestamp_ntz"), ntz("1970-01-01"))


def day_start(ts: ColumnLike) -> Column:
    return F.to_date(col(ts)).cast("timestamp_ntz")


def hour_start(ts: ColumnLike) -> Column:
    """Start of the hour, kept zone-free (``date_trunc`` would return a zoned type)."""
    return day_start(ts) + F.make_dt_interval(hours=F.hour(col(ts)))


@dataclass(frozen=True)
class Band:
    """A time band with explicit open or closed ends; ``None`` means unbounded."""

    name: str
    lo: datetime | None = None
    hi: datetime | None = None
    lo_closed: bool = True
    hi_closed: bool = False

    def contains(self, ts: ColumnLike) -> Column:
        t = col(ts)
        tests = []
        if self.lo is not None:
            tests.append(t >= ntz(self.lo) if self.lo_closed else t > ntz(self.lo))
        if self.hi is not None:
            tests.append(t <= ntz(self.hi) if self.hi_closed else t < ntz(self.hi))
        out = tests[0] if tests else F.lit(True)
        for test in tests[1:]:
            out = out & test
        return out


def earliest(bands: Sequence[Band]) -> datetime | None:
    """Lower bound shared by all bands, or ``None`` when one is unbounded."""
    lows = [b.lo for b in bands]
    return None if any(lo is None for lo in lows) else min(lows)


# --- nulls and text ----------------------------------------------------------


def cat(*parts: ColumnLike) -> Column:
    """Concatenation in which a null part adds nothing."""
    return F.concat_ws("", *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def short_host(host: ColumnLike, case: str | None = None) -> Column:
    """Text before the first dot, or the whole name when there is no dot."""
    out = F.substring_index(col(host), ".", 1)
    return {"upper": F.upper, "lower": F.lower, None: lambda c: c}[case](out)


def one_or_struct(*cs: ColumnLike) -> Column:
    """A plain column when there is one, else a struct; plain values keep hash aggregation possible."""
    return col(cs[0]) if len(cs) == 1 else F.struct(*[col(c) for c in cs])


def flagged(flag: ColumnLike, value: str = "Y") -> Column:
    return col(flag) == F.lit(value)


def not_disabled(flag: ColumnLike = "disabled") -> Column:
    """A null flag is neither enabled nor disabled, so such rows drop out."""
    return col(flag) != F.lit("Y")


def version_number(version: ColumnLike) -> Column:
    """'11.2.0.4' -> 112: the first two parts glued together."""
    parts = F.split(col(version), r"\.")
    return cat(F.get(parts, F.lit(0)), F.get(parts, F.lit(1))).try_cast("int")


def version_sort_key(version: ColumnLike) -> Column:
    """Numeric parts as an array, so that 9.2 sorts before 12.1."""
    return F.transform(F.split(col(version), r"\."), lambda p: p.try_cast("int"))


def humanise_bytes(size: ColumnLike) -> Column:
    """Whole gigabytes from 2^30 bytes up, else whole megabytes."""
    b = col(size)
    gb = F.concat(F.round(b / F.lit(float(1 << 30))).cast("long").cast("string"), F.lit(" GB"))
    mb = F.concat(F.round(b / F.lit(float(1 << 20))).cast("long").cast("string"), F.lit(" MB"))
    return F.when(b > (1 << 30) - 1, gb).otherwise(mb)


def scientific(value: ColumnLike) -> Column:
    number = col(value).cast("double")
    return F.when(number.isNotNull(), F.format_string("%.2E", number))


def directory_of(path: ColumnLike) -> Column:
    """Everything before the last slash ('' when there is none)."""
    return F.regexp_extract(col(path), r"^(.*)/", 1)


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def mean_if(value: ColumnLike, when: Column) -> Column:
    """Mean of the values that satisfy ``when``; null when there are none."""
    v = F.when(when, col(value))
    return F.try_divide(F.sum(v).cast("double"), F.count(v).cast("double"))


def left_join_null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Left join in which null keys match each other; the key columns come from the left."""
    keys = columns(keys)
    renamed = right.select(
        *[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, on, "left").drop(*[f"_right_{k}" for k in keys])
