from datetime import datetime

import pytest

from fleetlens.operators import usage as us

STATS = (
    "con_id int, con_name string, name string, dbid int, version string, last_sample_date timestamp_ntz, detected_usages int, "
    "total_samples int, currently_used string, first_usage_date timestamp_ntz, last_usage_date timestamp_ntz, aux_count int, feature_info string"
)
MAP = "product string, feature string, mversion string, condition string"
DAY = datetime(2024, 1, 1)


def stat(version="11.2.0.3.0", con=0, used=1, samples=5, current="TRUE", info=None, name="F", date=DAY, aux=0):
    return (con, f"C{con}", name, 1, version, date, used, samples, current, DAY, DAY, aux, info)


def classes(spark, stats, rules):
    out = us.classified_usage(spark.createDataFrame(stats, STATS), spark.createDataFrame(rules, MAP))
    return [r.usage_class for r in out.collect()]


@pytest.mark.parametrize("version,kept", [("11.2.0.3.0", True), ("11.2.0.4.0", False), ("12.1.0.2.0", False)])
def test_longest_prefix(spark, version, kept):
    rules = [("P", "F", "11.2", " "), ("P", "F", "11.2.0.4", "INVALID"), ("P", "F", "12.1", "INVALID")]
    assert bool(classes(spark, [stat(version)], rules)) is kept


@pytest.mark.parametrize(
    "condition,info,current,used,expected",
    [
        (" ", None, "TRUE", 1, us.CURRENT_USAGE),
        (None, None, "FALSE", 1, us.PAST_USAGE),
        (" ", None, "TRUE", 0, us.NO_CURRENT_USAGE),
        ("BUG", None, "TRUE", 1, us.SUPPRESSED),
        ("C001", "Compression used:  TRUE", "TRUE", 1, us.CURRENT_USAGE),
        ("C001", "compression used: 10 times", "TRUE", 1, us.PAST_OR_CURRENT_USAGE),
        ("C001", "compression used: 0 times", "TRUE", 1, us.NO_CURRENT_USAGE),
        ("C002", "encryption used: TRUE", "FALSE", 1, us.PAST_USAGE),
        ("C001", None, "TRUE", 1, us.NO_CURRENT_USAGE),
    ],
)
def test_usage_classes(spark, condition, info, current, used, expected):
    assert classes(spark, [stat(info=info, current=current, used=used)], [("P", "F", "11", condition)]) == [expected]


def test_old_sample_and_never_sampled(spark):
    rows = [stat(), stat(date=datetime(2023, 1, 1), used=0), stat(samples=0)]
    assert sorted(classes(spark, rows, [("P", "F", "11", " ")])) == [us.NO_PAST_USAGE, us.CURRENT_USAGE]


def test_container_condition(spark):
    rules = [("P", "F", "11", "C003")]
    assert classes(spark, [stat(con=1, aux=2)], rules) == [us.CURRENT_USAGE]
    assert classes(spark, [stat(con=1, aux=1)], rules) == [us.NO_CURRENT_USAGE]
    assert classes(spark, [stat(con=3, aux=2)], rules) == []


def test_totals_only_for_containers(spark):
    rules = [("P", "F", "11", " ")]
    report = lambda rows: us.product_usage(
        us.classified_usage(spark.createDataFrame(rows, STATS), spark.createDataFrame(rules, MAP))
    )
    assert [r.gid for r in report([stat()]).collect()] == [0]
    got = us.report_order(report([stat(con=3), stat(con=4, current="FALSE")])).collect()
    assert [(r.gid, r.con_name, r.usage) for r in got] == [
        (1, "--ALL--", "CURRENT_USAGE"), (0, "C3", "CURRENT_USAGE"), (0, "C4", "PAST_USAGE"),
    ]


def test_numeric_and_text_versions(spark):
    df = spark.createDataFrame([stat("9.2.0"), stat("12.1.0")], STATS)
    assert us.feature_usage(df, ["F"], {}).first().version == "12.1.0"
    assert us.feature_usage(df, ["F"], {}, numeric_versions=False).first().version == "9.2.0"


def test_never_sampled_remark(spark):
    df = spark.createDataFrame([stat(date=None, samples=0)], STATS)
    assert us.latest_sample(df).first().remarks == "NEVER SAMPLED !!!"
