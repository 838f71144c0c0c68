"""Readers for load files, listings, connection files and logs.

Files are read line by line and in parallel. Header and underline rows are not
skipped by position, which would need the start of each file, but drop out
because their text does not fit the typed columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.semantics import columns, short_host


@dataclass(frozen=True)
class Field:
    """A column of a load file. Dates need a ``fmt``; a weekday prefix in the text is cut off."""

    name: str
    kind: str = "string"
    fmt: str | None = None
    weekday_prefix: bool = False

    def typed(self) -> Column:
        text = F.nullif(F.col(self.name), F.lit(""))
        if self.fmt is not None:
            if self.weekday_prefix:
                text = F.substring(text, 5, 1000)
            return F.try_to_timestamp(text, F.lit(self.fmt)).cast("timestamp_ntz")
        return text if self.kind == "string" else text.try_cast(self.kind)


def typed_rows(raw: DataFrame, fields: Sequence[Field]) -> DataFrame:
    """Typed projection of an all-text frame; rows with a text that does not fit its type are dropped."""
    fits = F.lit(True)
    for f in fields:
        if f.kind != "string" or f.fmt is not None:
            fits = fits & (F.nullif(F.col(f.name), F.lit("")).isNull() | f.typed().isNotNull())
    return raw.filter(fits).select(*[f.typed().alias(f.name) for f in fields])


def read_delimited(spark: SparkSession, path, fields: Sequence[Field], sep: str = ", ") -> DataFrame:
    """Delimited load file: short rows end in nulls, unreadable rows are dropped."""
    schema = ", ".join(f"`{f.name}` string" for f in fields)
    raw = spark.read.schema(schema).option("sep", sep).option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return typed_rows(raw, fields)


def split_lines(spark: SparkSession, path, fields: Sequence[Field], sep: str = ", ") -> DataFrame:
    """file, line, the fields as text, and ``reason``: why the line is no row (null if it is one).

    The first field whose text does not fit its type is named. One pass serves both parts.
    """
    parts = F.split("line", "\\Q" + sep + "\\E", -1)
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    raw = raw.select("file", "line", *[F.get(parts, F.lit(i)).alias(f.name) for i, f in enumerate(fields)])
    reasons = [F.when(F.trim("line") == "", F.lit("empty line"))]
    for f in fields:
        if f.kind != "string" or f.fmt is not None:
            unread = F.nullif(F.col(f.name), F.lit("")).isNotNull() & f.typed().isNull()
            reasons.append(F.when(unread, F.concat(F.lit(f"{f.name}: '"), F.col(f.name), F.lit(f"' is no {f.fmt or f.kind}"))))
    return raw.withColumn("reason", F.coalesce(*reasons))


def read_delimited_and_rejects(spark: SparkSession, path, fields: Sequence[Field], sep: str = ", ") -> tuple[DataFrame, DataFrame]:
    """Typed rows of a delimited load file, and its other lines as (file, line, reason).

    Together they are all lines of the files, headings and underlines included.
    """
    lines = split_lines(spark, path, fields, sep)
    rows = lines.filter(F.col("reason").isNull()).select(*[f.typed().alias(f.name) for f in fields])
    return rows, lines.filter(F.col("reason").isNotNull()).select("file", "line", "reason")


def read_space_delimited(spark: SparkSession, path, fields: Sequence[Field]) -> DataFrame:
    return read_delimited(spark, path, fields, sep=" ")


def read_fixed_width(spark: SparkSession, path, fields: Sequence[tuple[Field, int, int]]) -> DataFrame:
    """Positional text: each field is ``(field, first, last)`` counted from 1, trailing blanks cut."""
    lines = spark.read.text(path)
    raw = lines.select(*[F.rtrim(F.substring("value", a, b - a + 1)).alias(f.name) for f, a, b in fields])
    return typed_rows(raw, [f for f, _, _ in fields])


def read_quoted_csv(spark: SparkSession, path, names: Sequence[str]) -> DataFrame:
    """Exported CSV: quotes and carriage returns removed, a trailing comma ignored."""
    schema = ", ".join(f"`{n}` string" for n in names)
    raw = spark.read.schema(schema).option("quote", '"').csv(path)
    return raw.select(*[F.regexp_replace(n, r"\r$", "").alias(n) for n in names])


# Fixed positions of the printed metric report.
METRIC_REPORT = [
    ("metric", 1, 33),
    ("space_time", 34, 50),
    ("filler1", 52, 52),
    ("nowcol", 54, 63),
    ("fivemin", 65, 74),
    ("tenmin", 76, 85),
    ("fifteenmin", 87, 96),
    ("thirtymin", 98, 107),
    ("fortyfivemin", 109, 118),
    ("sixtymin", 120, 129),
    ("filler2", 131, 131),
    ("fifteenav", 133, 142),
    ("hourav", 144, 153),
    ("twohrav", 155, 164),
    ("sixhrav", 166, 175),
    ("todayav", 177, 186),
    ("ydayav", 188, 197),
]


def metric_report_fields() -> list[tuple[Field, int, int]]:
    """Fields of the metric report: the time is a date, 'N/A' figures become null."""
    out = []
    for name, first, last in METRIC_REPORT:
        fmt = "dd-MM-yy HH:mm:ss" if name == "space_time" else None
        out.append((Field(name, fmt=fmt), first, last))
    return out


# Load-file layouts.
FILESYSTEM_LOAD = [
    Field("server"),
    Field("filesystem"),
    Field("sizek", "bigint"),
    Field("usedk", "bigint"),
    Field("availk", "bigint"),
    Field("pctused", "int"),
    Field("mountpoint"),
    Field("df_dow"),
    Field("space_time", fmt="dd-MMM-yyyy-HH:mm:ss", weekday_prefix=True),
]
METRIC_LOAD = [
    Field("database_name"),
    Field("server"),
    Field("space_time", fmt="dd-MM-yy HH:mm:ss"),
    Field("metric"),
    Field("value", "double"),
]
TOTAL_LOAD = [
    Field("database_name"),
    Field("server"),
    Field("space_time", fmt="dd-MM-yy HH:mm:ss"),
    Field("gig_data", "decimal(9,2)"),
    Field("gig_free", "decimal(9,2)"),
    Field("gig_used", "decimal(9,2)"),
    Field("gig_temp", "decimal(9,2)"),
]
TABLESPACE_LOAD = [
    Field("server"),
    Field("database_name"),
    Field("tablespace_name"),
    Field("space_time", fmt="dd-MM-yy HH:mm:ss"),
    Field("meg_data", "decimal(9,2)"),
    Field("meg_free", "decimal(9,2)"),
    Field("meg_used", "decimal(9,2)"),
    Field("meg_temp", "decimal(9,2)"),
]
FILE_SPACE_LOAD = [
    Field("full_file_name"),
    Field("file_name"),
    Field("dir_name"),
    Field("file_system"),
    Field("free_space", "bigint"),
    Field("mount_point"),
    Field("space_chartime"),
]
RECONCILE_LOAD = [Field("database_name"), Field("dbid", "bigint"), Field("host_name")]


def parse_df_listing(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Filesystem listings (one text each) to rows; records wrapped over two lines are rejoined."""
    body = F.regexp_replace(F.col(text), r"^[^\n]*\n", "")
    joined = F.regexp_replace(body, r"(?m)^(\S+)[ \t]*\n[ \t]+(\S+(?:[ \t]+\S+){4})[ \t]*$", "$1 $2")
    lines = df.select(*keep, F.explode(F.split(joined, "\n")).alias("line"))
    parts = F.split(F.trim(F.regexp_replace("line", r"\s+", " ")), " ")
    names = ["filesystem", "sizek", "usedk", "availk", "pctused", "mountpoint"]
    rows = lines.select(*keep, parts.alias("p")).filter(F.size("p") == 6)
    cells = rows.select(*keep, *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(names)])
    number = {n: F.regexp_replace(n, "%", "").try_cast("bigint") for n in names[1:5]}
    return cells.select(*keep, *[number.get(n, F.col(n)).alias(n) for n in names])


def read_df_listings(spark: SparkSession, path) -> DataFrame:
    """One listing per file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return parse_df_listing(files, "text", ["file"])


def connection_aliases(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct alias names of a connection file: what stands before '=' on a line that starts with a letter."""
    name = F.trim(F.regexp_extract(line, r"^([A-Za-z][^=]*)=", 1))
    return lines.select(name.alias("alias")).filter(F.col("alias") != "").distinct()


def connection_hosts(lines: DataFrame, line: str = "value") -> DataFrame:
    """Distinct upper-case host names of a connection file."""
    found = F.regexp_extract_all(F.upper(line), F.lit(r"HOST\s*=\s*([^)\s]+)"), F.lit(1))
    return lines.select(F.explode(found).alias("host")).distinct()


def alias_hosts(texts: DataFrame, text: str = "value") -> DataFrame:
    """Short host of each alias in connection texts; every text holds whole entries."""
    entries = F.split(F.col(text), r"\n(?=[A-Za-z])")
    entry = texts.select(F.explode(entries).alias("entry"))
    host = F.regexp_extract("entry", r"(?is)HOST\s*=\s*([^)\s]+)", 1)
    alias = F.trim(F.regexp_extract("entry", r"^([A-Za-z][^=]*)=", 1))
    return (
        entry.select(alias.alias("alias"), short_host(host).alias("host"))
        .filter((F.col("alias") != "") & (F.col("host") != ""))
        .distinct()
    )


def read_log(spark: SparkSession, path) -> DataFrame:
    """Log lines with their file and an order that follows the file, also across splits."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("log"),
        F.struct(
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")
        ).alias("position"),
        F.col("value").alias("line"),
    )


def log_since(lines: DataFrame, stamp: str, log="log", position: str = "position", line: str = "line") -> DataFrame:
    """Lines from the first one that contains ``stamp`` to the end, per log; logs without it drop out.

    The first position is an aggregate per log, so no log is gathered in one task.
    """
    log = columns(log)
    first = lines.filter(F.col(line).contains(stamp)).groupBy(*log).agg(F.min(position).alias("_first"))
    return lines.join(first, log).filter(F.col(position) >= F.col("_first")).drop("_first")


def log_last(lines: DataFrame, n: int, log="log", position: str = "position") -> DataFrame:
    """Last ``n`` lines per log. Spark limits groups before the shuffle up to
    ``spark.sql.optimizer.windowGroupLimitThreshold`` rows."""
    window = Window.partitionBy(*columns(log)).orderBy(F.desc(position))
    return lines.withColumn("_back", F.row_number().over(window)).filter(F.col("_back") <= n).drop("_back")
