"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the cores. Each figure is the median
of three warm runs into a sink that discards rows. The ``*_separate_scans``
entries are the forms the single-pass operators replace, for comparison; they
are not part of the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fleetlens.operators import capacity, latest, series  # noqa: E402
from fleetlens.plans.capacity import ENTITY, usage_history  # noqa: E402
from fleetlens.plans.registry import AS_OF, ORDERS_AS_OF, Tables, load_all  # noqa: E402
from fleetlens.plans.series import day_bands, metric_history  # noqa: E402
from fleetlens.session import configured  # noqa: E402

HEADLINE = [
    "c02_band_compare",
    "c03b_growth_status_tiered",
    "c07_daily_high_water",
    "c08_growth_report",
    "c10_container_usage",
    "m03_lag_panel",
    "m04_window_averages",
    "m05_metric_panel",
    "m06_counter_deltas",
    "m09_gap_check",
    "s01_upsert",
    "v02_rows_in_blackout",
    "v04_checks_to_run",
    "v08_mixed_environment",
    "b02_last_backup",
    "b07_backup_verdict",
    "b12_backup_matrix",
    "k02_blocked_waiters",
    "l06_product_usage",
    "a01_classify_lines",
    "a04_notify_on_change",
    "a08_error_histogram",
]


def bands_by_scans(t):
    out = None
    for band in capacity.capacity_bands(AS_OF):
        part = latest.top_rows(usage_history(t).filter(band.contains("ts")), ENTITY, latest.newest_first("ts", "event_id"))
        part = part.select(*ENTITY, F.col("pctused").alias(band.name))
        out = part if out is None else out.join(part, ENTITY)
    return out


def averages_by_scans(t):
    bands = day_bands()
    bands.sort(key=lambda b: b.name != "today")
    out = None
    for band in bands:
        part = series.window_averages(metric_history(t), ENTITY, "ts", "value", [band], anchor=band.name)
        out = part if out is None else out.join(part, ENTITY, "left")
    return out


def growth_by_scans(t):
    out = None
    for name, days in (("month", 31), ("six_month", 183), ("year", 365)):
        part = capacity.growth_report(
            t.orders, "o_custkey", "o_orderdate", "o_totalprice", ORDERS_AS_OF, horizons={name: days}, tie_break=["o_orderkey"]
        )
        if out is not None:
            part = part.drop("date_now", "now_used")
        out = part if out is None else out.join(part, "o_custkey")
    return out


COMPARED = {
    "c02_separate_scans": bands_by_scans,
    "m04_separate_scans": averages_by_scans,
    "c08_separate_scans": growth_by_scans,
}


def timed(build) -> float:
    def once() -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    once()
    return round(statistics.median(once() for _ in range(3)), 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = configured(SparkSession.builder.master(f"local[{cpus}]").appName("bench"))
    spark = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    queries = load_all()
    tables = Tables(spark, folder)
    times = {name: timed(lambda q=queries[name]: q(spark, folder)) for name in HEADLINE}
    total = round(sum(times.values()), 3)
    for name, build in COMPARED.items():
        times[name] = timed(lambda b=build: b(tables))
    spark.stop()
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
