"""Product-usage queries: parts as feature statistics, brands as versions."""

from pyspark.sql import functions as F

from fleetlens.operators import usage as us
from fleetlens.plans.health import banners
from fleetlens.plans.registry import query, sql_values


def stats(t):
    key, size = F.col("p_partkey"), F.col("p_size")
    day0 = F.lit("2020-01-01").cast("timestamp_ntz")
    info = (
        F.when(key % 5 == 0, F.concat(F.lit("x compression used: TRUE "), size))
        .when(key % 5 == 1, F.concat(F.lit("Compression used: "), size % 3, F.lit(" times")))
        .when(key % 5 == 2, F.concat(F.lit("encryption used:   true; n="), size))
        .when(key % 5 == 3, F.concat(F.lit("Encryption used:0"), size % 4, F.lit(" time")))
    )
    return t.part.select(
        (size % 3).alias("con_id"),
        F.concat(F.lit("PDB"), size % 3).alias("con_name"),
        F.col("p_type").alias("name"),
        (key % 7).alias("dbid"),
        F.col("p_brand").alias("version"),
        F.when(size != 50, day0 + F.make_dt_interval(days=(key % 400).cast("int"))).alias("last_sample_date"),
        (key % 4).alias("detected_usages"),
        (size % 10).alias("total_samples"),
        F.when(key % 2 == 0, "TRUE").otherwise("FALSE").alias("currently_used"),
        F.when(key % 4 != 0, day0 - F.make_dt_interval(days=size)).alias("first_usage_date"),
        F.when(key % 4 != 0, day0 + F.make_dt_interval(days=size)).alias("last_usage_date"),
        (size % 4).alias("aux_count"),
        info.alias("feature_info"),
    )


STATS_SQL = """st AS (SELECT p_size % 3 AS con_id, 'PDB' || (p_size % 3) AS con_name, p_type AS name, p_partkey % 7 AS dbid,
      p_brand AS version, CASE WHEN p_size <> 50 THEN TIMESTAMP '2020-01-01' + to_days(CAST(p_partkey % 400 AS INT)) END AS last_sample_date,
      p_partkey % 4 AS detected_usages, p_size % 10 AS total_samples, CASE WHEN p_partkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS currently_used,
      CASE WHEN p_partkey % 4 <> 0 THEN TIMESTAMP '2020-01-01' - to_days(p_size) END AS first_usage_date,
      CASE WHEN p_partkey % 4 <> 0 THEN TIMESTAMP '2020-01-01' + to_days(p_size) END AS last_usage_date,
      p_size % 4 AS aux_count, CASE p_partkey % 5 WHEN 0 THEN 'x compression used: TRUE ' || p_size
        WHEN 1 THEN 'Compression used: ' || (p_size % 3) || ' times' WHEN 2 THEN 'encryption used:   true; n=' || p_size
        WHEN 3 THEN 'Encryption used:0' || (p_size % 4) || ' time' END AS feature_info FROM part)"""

PRODUCTS = [
    ("Compression", "ECONOMY", "Brand#1", "C001"),
    ("Compression", "ECONOMY", "Brand#12", "INVALID"),
    ("Compression", "ECONOMY", "Brand#2", None),
    ("Encryption", "LARGE", "Brand#", "C002"),
    ("Encryption", "LARGE", "Brand#2", "BUG"),
    (".Containers", "MEDIUM", "Brand#1", "C003"),
    (".Containers", "MEDIUM", "Brand#2", " "),
    ("Analytics", "SMALL", "Brand#", " "),
    ("Analytics", "PROMO", "Brand#3", " "),
    ("Spatial", "STANDARD", "Brand#1", "C001"),
    ("Spatial", "STANDARD", "Brand#15", "C002"),
]
MAP_SQL = f"mp AS (SELECT * FROM (VALUES {sql_values(PRODUCTS)}) v(product, feature, mversion, condition))"


def product_map(t):
    return t.rows(PRODUCTS, "product string, feature string, mversion string, condition string")


@query(
    "l01_feature_usage",
    f"""WITH {STATS_SQL}, v AS (SELECT name, arg_max(version, CAST(substr(version, 7) AS INT)) AS version FROM st GROUP BY name)
    SELECT st.* FROM st JOIN v USING (name, version) WHERE detected_usages > 0
      AND (name IN ('LARGE', 'SMALL') OR (name = 'PROMO' AND feature_info LIKE '%ompression used: %'))""",
)
def l01(t):
    numbered = stats(t).withColumn("version", F.regexp_replace("version", "Brand#", ""))
    found = us.feature_usage(numbered, ["LARGE", "SMALL"], {"PROMO": "%ompression used: %"})
    return found.withColumn("version", F.concat(F.lit("Brand#"), "version"))


@query(
    "l01_feature_usage_text_order",
    f"""WITH {STATS_SQL} SELECT * FROM st WHERE version = (SELECT max(version) FROM st x WHERE x.name = st.name)
      AND detected_usages > 0 AND name IN ('LARGE', 'SMALL', 'ECONOMY')""",
)
def l01_text(t):
    return us.feature_usage(stats(t), ["LARGE", "SMALL", "ECONOMY"], {}, numeric_versions=False)


NEWEST_SQL = """nw AS (SELECT con_id, dbid, version, last_sample_date FROM st
      QUALIFY row_number() OVER (PARTITION BY con_id ORDER BY last_sample_date DESC NULLS LAST, dbid DESC, version DESC) = 1)"""


def fleet_stats(t):
    """The statistics by database; one of them was never sampled."""
    never = F.col("database") == "DB9"
    rows = stats(t).withColumn("database", F.concat(F.lit("DB"), F.when(F.col("aux_count") == 3, 9).otherwise(F.col("aux_count"))))
    rows = rows.withColumn("last_sample_date", F.when(~never, F.col("last_sample_date")))
    return rows.withColumn("total_samples", F.when(never, 0).otherwise(F.col("total_samples")))


@query(
    "l02_latest_sample",
    f"""WITH {STATS_SQL}, f AS (SELECT * REPLACE (CASE WHEN aux_count <> 3 THEN last_sample_date END AS last_sample_date,
      CASE WHEN aux_count = 3 THEN 0 ELSE total_samples END AS total_samples), 'DB' || CASE aux_count WHEN 3 THEN 9 ELSE aux_count END AS database FROM st),
    r AS (SELECT database, max(last_sample_date) IS NULL AND max(total_samples) = 0 AS never FROM f GROUP BY database)
    SELECT database, con_id, max_by(dbid, k) AS last_dbid, max_by(version, k) AS last_version, max(last_sample_date) AS last_sample_date,
      CASE WHEN any_value(never) THEN 'NEVER SAMPLED !!!' ELSE '' END AS remarks
    FROM (SELECT *, (coalesce(last_sample_date, TIMESTAMP '1000-01-01'), dbid, version) AS k FROM f JOIN r USING (database)) GROUP BY database, con_id""",
)
def l02(t):
    return us.latest_sample(fleet_stats(t), database="database")


CURRENT_SQL = f"""{STATS_SQL}, {NEWEST_SQL}, cu AS (SELECT st.*, CASE WHEN st.dbid = nw.dbid AND st.version = nw.version
      AND st.last_sample_date IS NOT DISTINCT FROM nw.last_sample_date THEN 'Y' ELSE 'N' END AS current_entry FROM st JOIN nw USING (con_id))"""


@query("l03_mark_current", f"WITH {CURRENT_SQL} SELECT * FROM cu")
def l03(t):
    return us.mark_current(stats(t))


# The longest prefix is sought once for each name and version, whatever the container.
MAPPED_SQL = f"""{CURRENT_SQL}, {MAP_SQL},
    seen AS (SELECT DISTINCT name, version FROM st WHERE total_samples > 0),
    fits AS (SELECT name, version, max(length(mversion)) AS n FROM seen JOIN mp ON feature = name AND starts_with(version, mversion) GROUP BY ALL),
    pf AS (SELECT cu.*, product, condition, mversion FROM cu JOIN fits ON fits.name = cu.name AND fits.version = cu.version
      JOIN mp ON feature = cu.name AND mversion = left(cu.version, n)
      WHERE total_samples > 0 AND condition IS DISTINCT FROM 'INVALID' AND (con_id <= 1 OR condition IS DISTINCT FROM 'C003'))"""


@query("l04_best_prefix_map", f"WITH {MAPPED_SQL} SELECT * EXCLUDE (current_entry) FROM pf")
def l04(t):
    return us.best_prefix_map(stats(t), product_map(t))


# What a feature's text says where it was used (for sure, or perhaps only once).
TEXTS = [
    ("C001", "(?i)compression used: *TRUE", "(?i)compression used:[ 0-9]*[1-9][ 0-9]*time"),
    ("C002", "(?i)encryption used: *TRUE", "(?i)encryption used:[ 0-9]*[1-9][ 0-9]*time"),
]
# evidence of use (none, perhaps, sure), the entry's state (old, current, current and in use), class
CLASSES = [(0, 0, 1), (0, 1, 2), (0, 2, 2), (1, 0, 4), (1, 1, 4), (1, 2, 5), (2, 0, 4), (2, 1, 4), (2, 2, 6)]
LABELS = [
    (1, "NO_USAGE"), (2, "NO_USAGE"), (3, "SUPPRESSED_DUE_TO_BUG"), (4, "PAST_USAGE"), (5, "PAST_OR_CURRENT_USAGE"), (6, "CURRENT_USAGE"),
]
CLASS_SQL = f"""{MAPPED_SQL}, tx AS (SELECT * FROM (VALUES {sql_values(TEXTS)}) v(rule, sure, perhaps)),
    lv AS (SELECT * FROM (VALUES {sql_values(CLASSES)}) v(evidence, state, found)),
    ev AS (SELECT pf.*, coalesce(detected_usages, 0) > 0 AS used, coalesce(trim(condition), '') = '' AS plain,
      coalesce(regexp_matches(feature_info, sure), false) OR (condition = 'C003' AND con_id = 1 AND aux_count > 1) AS proven,
      coalesce(regexp_matches(feature_info, perhaps), false) AS likely,
      (current_entry = 'Y')::INT * (1 + (currently_used IS NOT DISTINCT FROM 'TRUE')::INT) AS state FROM pf LEFT JOIN tx ON rule = condition),
    cl AS (SELECT ev.* EXCLUDE (used, plain, proven, likely, state), if(condition IS NOT DISTINCT FROM 'BUG', 3, found) AS usage_class
      FROM ev JOIN lv ON lv.state = ev.state AND evidence = used::INT * greatest(2 * (plain OR coalesce(proven, false))::INT, likely::INT))"""


def classified(t):
    return us.classified_usage(stats(t), product_map(t))


@query("l05_usage_class", f"WITH {CLASS_SQL} SELECT * FROM cl")
def l05(t):
    return classified(t)


def report_sql(where: str) -> str:
    """One row per product and container, and one per product over all that are more than a root."""
    figures = """product, max(usage_class) AS class, max(last_sample_date) AS last_sample_date,
      min(first_usage_date) AS first_usage_date, max(last_usage_date) AS last_usage_date"""
    return f"""WITH {CLASS_SQL}, lb AS (SELECT * FROM (VALUES {sql_values(LABELS)}) v(class, usage)),
    w AS (SELECT * FROM cl WHERE {where}),
    r AS (SELECT 0 AS gid, con_id, max(con_name) AS con_name, {figures} FROM w GROUP BY con_id, product
      UNION ALL SELECT 1, NULL, '--ALL--', {figures} FROM w GROUP BY product HAVING max(con_id) > 0)
    SELECT gid, con_id, con_name, product, usage, last_sample_date, first_usage_date, last_usage_date FROM r JOIN lb ON lb.class = r.class"""


@query("l06_product_usage", report_sql("usage_class IN (2, 4, 5, 6)"))
def l06(t):
    return us.report_order(us.product_usage(classified(t)))


@query(
    "l06_product_usage_current",
    report_sql("usage_class IN (2, 5, 6) AND (last_usage_date IS NOT NULL OR first_usage_date IS NOT NULL)"),
)
def l06_current(t):
    return us.report_order(us.product_usage(classified(t), current_only=True))


DETAIL_SQL = f"""WITH {CLASS_SQL} SELECT con_id, con_name, product, name AS feature_being_used, CASE usage_class WHEN 2 THEN 'NO_CURRENT_USAGE'
      WHEN 3 THEN 'SUPPRESSED_DUE_TO_BUG' WHEN 4 THEN 'PAST_USAGE' WHEN 5 THEN 'PAST_OR_CURRENT_USAGE' ELSE 'CURRENT_USAGE' END AS usage,
      last_sample_date, dbid, version, detected_usages, total_samples, currently_used, first_usage_date, last_usage_date,
      CASE condition WHEN 'C001' THEN nullif(regexp_extract(feature_info, '(?i)compression used:(.*?)(times|TRUE|FALSE)'), '')
        WHEN 'C002' THEN nullif(regexp_extract(feature_info, '(?i)encryption used:(.*?)(times|TRUE|FALSE)'), '')
        WHEN 'C003' THEN 'AUX_COUNT=' || aux_count END AS extra_feature_info
    FROM cl WHERE usage_class <> 1"""


@query("l07_feature_detail", DETAIL_SQL)
def l07(t):
    return us.feature_detail(classified(t))


@query("l07_feature_detail_used", DETAIL_SQL + " AND (last_usage_date IS NOT NULL OR detected_usages > 0) AND dbid = 3")
def l07_used(t):
    return us.feature_detail(classified(t), dbid=3, used_only=True)


@query(
    "l08_container_remarks",
    """WITH c AS (SELECT s_nationkey AS con_id, s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'MOUNTED' ELSE 'READ WRITE' END AS open_mode
      FROM supplier)
    SELECT *, CASE WHEN open_mode NOT LIKE 'READ%' AND con_id = 4 THEN
        'NOT OPEN! DBA_FEATURE_USAGE_STATISTICS is not accessible. *CURRENT CONTAINER'
      WHEN open_mode NOT LIKE 'READ%' THEN 'NOT OPEN! DBA_FEATURE_USAGE_STATISTICS is not accessible.'
      WHEN con_id = 4 THEN '*CURRENT CONTAINER. Only data for this PDB will be listed.' ELSE '' END AS remarks FROM c""",
)
def l08(t):
    containers = t.supplier.select(
        F.col("s_nationkey").alias("con_id"),
        F.col("s_name").alias("name"),
        F.when(F.col("s_acctbal") < 3000, "MOUNTED").otherwise("READ WRITE").alias("open_mode"),
    )
    return us.container_remarks(containers, 4, True)


@query(
    "l09_overall_card",
    """SELECT c_custkey AS dbid, 'host' || c_nationkey AS host_name, c_name AS instance_name, '12.1.0' AS version,
      c_mktsegment AS database_name, 'READ WRITE' AS open_mode, 'PRIMARY' AS database_role, c_acctbal AS created,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Oracle Enterprise Edition' ELSE 'Oracle Standard' END AS banner
    FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""",
)
def l09(t):
    instances = t.customer.select(
        F.col("c_custkey").alias("dbid"),
        F.concat(F.lit("host"), "c_nationkey").alias("host_name"),
        F.col("c_name").alias("instance_name"),
        F.lit("12.1.0").alias("version"),
    )
    databases = t.customer.select(
        F.col("c_custkey").alias("dbid"),
        F.col("c_mktsegment").alias("name"),
        F.lit("READ WRITE").alias("open_mode"),
        F.lit("PRIMARY").alias("database_role"),
        F.col("c_acctbal").alias("created"),
    )
    return us.overall_card(instances, databases, banners(t))


@query(
    "l09_audited_parameters",
    """SELECT DISTINCT 'DB' || p_size % 3 AS database, CASE p_type WHEN 'PROMO' THEN 'ENABLE_DDL_LOGGING' ELSE 'control_management_pack_access' END AS parameter,
      p_brand AS value FROM part WHERE p_type IN ('PROMO', 'LARGE')""",
)
def l09_parameters(t):
    name = F.when(F.col("p_type") == "PROMO", "ENABLE_DDL_LOGGING").when(
        F.col("p_type") == "LARGE", "control_management_pack_access"
    ).otherwise(F.col("p_name"))
    database = F.concat(F.lit("DB"), F.col("p_size") % 3)
    return us.audited_parameters(t.part.select(database.alias("database"), name.alias("name"), F.col("p_brand").alias("value")), "database")
