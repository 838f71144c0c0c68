"""Reader queries: load files are written from the driver tables, then read back."""

from pyspark.sql import functions as F

from fleetlens.functions.semantics import short_host
from fleetlens.plans.registry import query
from fleetlens.plans.tables import scratch
from fleetlens.sources import logtail
from fleetlens.sources import readers as rd
from fleetlens.streaming import operators as st


def written(t, name, text):
    """Folder with the text column ``line`` of a frame, written in parallel."""
    path = scratch(t, name)
    text.select("line").write.text(path)
    return path


@query(
    "i01_read_filesystem_load",
    """SELECT 'srv' || user_id AS server, '/dev/' || event_type AS filesystem, event_id AS sizek,
      CAST(round(value * 100) AS BIGINT) AS usedk, NULL::BIGINT AS availk, CAST(user_id % 101 AS INT) AS pctused,
      '/' || event_type AS mountpoint, strftime(ts, '%a') AS df_dow, date_trunc('second', ts) AS space_time FROM events
    WHERE value >= 1""",
)
def i01(t):
    bad = F.when(F.col("value") < 1, "n/a").otherwise(F.col("event_id").cast("string"))
    line = F.concat_ws(
        ", ",
        F.concat(F.lit("srv"), "user_id"),
        F.concat(F.lit("/dev/"), "event_type"),
        bad,
        F.round(F.col("value") * 100).cast("long").cast("string"),
        F.lit(""),
        (F.col("user_id") % 101).cast("string"),
        F.concat(F.lit("/"), "event_type"),
        F.date_format("ts", "EEE"),
        F.date_format("ts", "EEE-dd-MMM-yyyy-HH:mm:ss"),
    )
    path = written(t, "filesystem", t.events.select(line.alias("line")))
    return rd.read_delimited(t.spark, path, rd.FILESYSTEM_LOAD)


def filesystem_lines(t):
    """Load lines with unreadable sizes and times, short lines, empty ones and a heading."""
    odd = F.col("event_id") % 50
    whole = F.concat_ws(
        ", ",
        F.concat(F.lit("srv"), "user_id"),
        F.concat(F.lit("/dev/"), "event_type"),
        F.when(odd == 1, "n/a").otherwise(F.col("event_id").cast("string")),
        F.col("user_id").cast("string"),
        F.lit(""),
        F.when(odd == 2, "9%").otherwise("9"),
        F.lit("/m"),
        F.lit("Mon"),
        F.when(odd == 3, "yesterday").otherwise("Mon-15-Jan-2024-10:00:00"),
    )
    line = F.when(odd == 4, "").when(odd == 5, F.concat(F.lit("srv"), "user_id")).otherwise(whole)
    heading = t.region.select(F.lit("SERVER, FILESYSTEM, SIZEK").alias("line"))
    return heading.union(t.events.select(line.alias("line")))


@query(
    "i01_load_rejects",
    """WITH e AS (SELECT event_id % 50 AS odd, event_id, user_id FROM events),
    m AS (SELECT * FROM (VALUES (1, 'sizek: ''n/a'' is no bigint'), (2, 'pctused: ''9%'' is no int'),
      (3, 'space_time: ''yesterday'' is no dd-MMM-yyyy-HH:mm:ss'), (4, 'empty line')) v(odd, reason))
    SELECT reason, count(*) AS lines FROM e JOIN m USING (odd) GROUP BY reason
    UNION ALL SELECT 'sizek: ''SIZEK'' is no bigint', count(*) FROM region
    UNION ALL SELECT 'read', count(*) FROM e WHERE odd NOT IN (1, 2, 3, 4)""",
)
def i01_rejects(t):
    rows, rejects = rd.read_delimited_and_rejects(t.spark, written(t, "rejects", filesystem_lines(t)), rd.FILESYSTEM_LOAD)
    both = rejects.select("reason").unionByName(rows.select(F.lit("read").alias("reason")))
    return both.groupBy("reason").agg(F.count(F.lit(1)).alias("lines"))


@query("i08_log_tail", "SELECT event_id || ' ' || event_type AS line, user_id % 3 AS part FROM events")
def i08_tail(t):
    """Three log files, followed as a stream into a table."""
    logtail.register(t.spark)
    path = scratch(t, "logs")
    line = F.concat_ws(" ", "event_id", "event_type", (F.col("user_id") % 3).cast("string"))
    t.events.select(line.alias("line")).coalesce(3).write.text(path)
    out = scratch(t, "followed")
    st.write_available(t.spark.readStream.format("log_tail").load(path), out + "/table", out + "/checkpoint")
    cells = F.split("line", " ")
    return t.spark.read.parquet(out + "/table").select(
        F.concat_ws(" ", cells[0], cells[1]).alias("line"), cells[2].cast("long").alias("part")
    )


@query(
    "i01_read_metric_load",
    """SELECT 'DB' || user_id AS database_name, 'srv' AS server, date_trunc('second', ts) AS space_time,
      CASE WHEN event_type <> 'signup' THEN upper(event_type) END AS metric,
      CASE WHEN event_type <> 'signup' THEN value END AS value FROM events""",
)
def i01_metric(t):
    """Signups give short rows; a heading and an underline are mixed in."""
    when = F.date_format("ts", "dd-MM-yy HH:mm:ss")
    whole = F.concat_ws(", ", F.concat(F.lit("DB"), "user_id"), F.lit("srv"), when, F.upper("event_type"), F.col("value").cast("string"))
    short = F.concat_ws(", ", F.concat(F.lit("DB"), "user_id"), F.lit("srv"), when)
    lines = t.events.select(F.when(F.col("event_type") == "signup", short).otherwise(whole).alias("line"))
    heading = t.region.select(F.lit("DATABASE_NAME, SERVER, SPACE_TIME, METRIC, VALUE").alias("line"))
    underline = t.region.select(F.lit("-------------, ------, ----------, ------, -----").alias("line"))
    path = written(t, "metric", heading.union(underline).union(lines))
    return rd.read_delimited(t.spark, path, rd.METRIC_LOAD)


@query(
    "i01_read_tablespace_load",
    """SELECT 'srv' || s_nationkey AS server, 'DB' || s_nationkey AS database_name, 'TS' || s_suppkey AS tablespace_name,
      TIMESTAMP '2024-01-05 10:11:12' AS space_time, CAST(s_acctbal AS DECIMAL(9,2)) AS meg_data, NULL::DECIMAL(9,2) AS meg_free,
      CAST(s_suppkey AS DECIMAL(9,2)) AS meg_used, NULL::DECIMAL(9,2) AS meg_temp FROM supplier""",
)
def i01_tablespace(t):
    line = F.concat_ws(
        ", ",
        F.concat(F.lit("srv"), "s_nationkey"),
        F.concat(F.lit("DB"), "s_nationkey"),
        F.concat(F.lit("TS"), "s_suppkey"),
        F.lit("05-01-24 10:11:12"),
        F.col("s_acctbal").cast("decimal(9,2)").cast("string"),
        F.lit(""),
        F.col("s_suppkey").cast("string"),
    )
    return rd.read_delimited(t.spark, written(t, "tablespace", t.supplier.select(line.alias("line"))), rd.TABLESPACE_LOAD)


@query(
    "i01_read_total_load",
    """SELECT c_name AS database_name, 'srv' || c_nationkey AS server, TIMESTAMP '2024-01-05 10:11:12' AS space_time,
      CAST(c_acctbal AS DECIMAL(9,2)) AS gig_data, CAST(1.5 AS DECIMAL(9,2)) AS gig_free, CAST(c_custkey AS DECIMAL(9,2)) AS gig_used,
      CAST(0 AS DECIMAL(9,2)) AS gig_temp FROM customer""",
)
def i01_total(t):
    line = F.concat_ws(
        ", ",
        "c_name",
        F.concat(F.lit("srv"), "c_nationkey"),
        F.lit("05-01-24 10:11:12"),
        F.col("c_acctbal").cast("decimal(9,2)").cast("string"),
        F.lit("1.5"),
        F.col("c_custkey").cast("string"),
        F.lit("0"),
    )
    return rd.read_delimited(t.spark, written(t, "total", t.customer.select(line.alias("line"))), rd.TOTAL_LOAD)


@query(
    "i01_read_reconcile_load",
    "SELECT c_name AS database_name, c_custkey + 1000 AS dbid, 'host' || c_nationkey AS host_name FROM customer",
)
def i01_reconcile(t):
    dbid = (F.col("c_custkey") + 1000).cast("string")
    line = F.concat_ws(", ", "c_name", dbid, F.concat(F.lit("host"), "c_nationkey"))
    return rd.read_delimited(t.spark, written(t, "reconcile", t.customer.select(line.alias("line"))), rd.RECONCILE_LOAD)


@query(
    "i02_read_space_delimited",
    """SELECT '/ctl/' || s_suppkey || '.dbf' AS full_file_name, s_suppkey || '.dbf' AS file_name, '/ctl' AS dir_name,
      '/dev/' || s_nationkey AS file_system, s_suppkey * 1000 AS free_space, '/u' || s_nationkey AS mount_point,
      '01/02/24-10:00:00' AS space_chartime FROM supplier""",
)
def i02(t):
    name = F.concat(F.col("s_suppkey"), F.lit(".dbf"))
    line = F.concat_ws(
        " ",
        F.concat(F.lit("/ctl/"), name),
        name,
        F.lit("/ctl"),
        F.concat(F.lit("/dev/"), "s_nationkey"),
        (F.col("s_suppkey") * 1000).cast("string"),
        F.concat(F.lit("/u"), "s_nationkey"),
        F.lit("01/02/24-10:00:00"),
    )
    path = written(t, "files", t.supplier.select(line.alias("line")))
    return rd.read_space_delimited(t.spark, path, rd.FILE_SPACE_LOAD)


@query(
    "i03_read_fixed_width",
    """SELECT event_type || ' ' || user_id AS metric, date_trunc('second', ts) AS space_time, '|' AS filler1,
      CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS nowcol, 'N/A' AS fivemin, '' || event_id AS sixtymin, '|' AS filler2,
      CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS ydayav FROM events""",
)
def i03(t):
    value = F.col("value").cast("decimal(18,2)").cast("string")
    cells = {
        "metric": F.concat_ws(" ", "event_type", F.col("user_id").cast("string")),
        "space_time": F.date_format("ts", "dd-MM-yy HH:mm:ss"),
        "filler1": F.lit("|"),
        "nowcol": value,
        "fivemin": F.lit("N/A"),
        "sixtymin": F.col("event_id").cast("string"),
        "filler2": F.lit("|"),
        "ydayav": value,
    }
    line, at = [], 1
    for name, first, last in rd.METRIC_REPORT:
        line += [F.lit(" " * (first - at)), F.rpad(cells.get(name, F.lit("")), last - first + 1, " ")]
        at = last + 1
    headings = t.region.select(F.lit("Metric                           Time             | Now").alias("line"))
    path = written(t, "report", headings.union(t.events.select(F.concat(*line).alias("line"))))
    return rd.read_fixed_width(t.spark, path, rd.metric_report_fields()).select(*cells)


@query(
    "i04_parse_df_listing",
    """SELECT o_orderkey, '/dev/long-name-' || o_custkey AS filesystem, o_orderkey AS sizek, o_custkey AS usedk, 7 AS availk,
      o_orderkey % 100 AS pctused, '/data' AS mountpoint FROM orders
    UNION ALL SELECT o_orderkey, '/dev/sda', o_custkey, o_custkey, 0, 100, '/' FROM orders""",
)
def i04(t):
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    pct = (F.col("o_orderkey") % 100).cast("string")
    text = F.concat(
        F.lit("Filesystem 1024-blocks Used Available Capacity Mounted on\n"),
        F.concat(F.lit("/dev/long-name-"), cust, F.lit("\n      "), key, F.lit("  "), cust, F.lit(" 7  "), pct, F.lit("% /data\n")),
        F.concat(F.lit("/dev/sda   "), cust, F.lit(" "), cust, F.lit(" 0 100% /\n")),
    )
    return rd.parse_df_listing(t.orders.select("o_orderkey", text.alias("text")), "text", ["o_orderkey"])


def connection_entries(t):
    entry = F.concat(
        F.lit("# entry\n"),
        "c_name",
        F.lit(".WORLD =\n  (DESCRIPTION = (ADDRESS = (PROTOCOL = TCP)(HOST = host"),
        "c_nationkey",
        F.lit(".example.com)(PORT = 1521)))"),
    )
    return t.customer.select(entry.alias("line"))


@query("i05_connection_aliases", "SELECT DISTINCT c_name || '.WORLD' AS alias FROM customer")
def i05(t):
    return rd.connection_aliases(t.spark.read.text(written(t, "aliases", connection_entries(t))))


@query("i05_connection_hosts", "SELECT DISTINCT 'HOST' || c_nationkey || '.EXAMPLE.COM' AS host FROM customer")
def i05_hosts(t):
    return rd.connection_hosts(t.spark.read.text(written(t, "hosts", connection_entries(t))))


@query("i05_alias_hosts", "SELECT DISTINCT c_name || '.WORLD' AS alias, 'host' || c_nationkey AS host FROM customer")
def i05_alias_hosts(t):
    return rd.alias_hosts(connection_entries(t), "line")


@query(
    "i06_read_quoted_csv",
    "SELECT s_name AS virtual_machine, 'NATION_' || s_nationkey AS cluster_name FROM supplier",
)
def i06(t):
    line = F.concat(F.lit('"'), "s_name", F.lit('","NATION_'), "s_nationkey", F.lit('",\r'))
    path = written(t, "vms", t.supplier.select(line.alias("line")))
    return rd.read_quoted_csv(t.spark, path, ["virtual_machine", "cluster_name"])


@query(
    "i07_short_host",
    """SELECT page_id, lower(split_part(regexp_extract(url, '://([^/]+)', 1), '.', 1)) AS host FROM pages""",
)
def i07(t):
    return t.pages.select("page_id", short_host(F.regexp_extract("url", "://([^/]+)", 1), "lower").alias("host"))


def user_logs(t):
    """One log per user: a day stamp, the time and the event type on each line."""
    line = F.concat_ws(" ", F.date_format("ts", "EEE MMM dd"), F.date_format("ts", "HH:mm:ss"), "event_type")
    return t.events.select(F.col("user_id").alias("log"), F.col("event_id").alias("position"), line.alias("line"))


LOG_SQL = """g AS (SELECT user_id AS log, event_id AS position, strftime(ts, '%a %b %d %H:%M:%S') || ' ' || event_type AS line
      FROM events)"""


@query(
    "i08_log_since",
    f"""WITH {LOG_SQL}, f AS (SELECT log, min(position) AS p FROM g WHERE contains(line, 'Thu Jan 18') GROUP BY log)
    SELECT g.* FROM g JOIN f USING (log) WHERE position >= p""",
)
def i08(t):
    return rd.log_since(user_logs(t), "Thu Jan 18")


@query(
    "i08_log_last",
    f"WITH {LOG_SQL} SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY log ORDER BY position DESC) <= 5",
)
def i08_last(t):
    return rd.log_last(user_logs(t), 5)
