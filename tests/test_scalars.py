"""Scalar rules on literal rows (traps T6, T11, T12, T13 and FIXTURES §7)."""

import math

from pyspark.sql import functions as F

from churnspark.functions import scalars as X


def _one_col(spark, values, ddl="v string"):
    return spark.createDataFrame([(v,) for v in values], ddl)


def test_coercion_cases(spark):
    df = _one_col(spark, ["abc", "", None, " 12.5 ", "1e3", "7"])
    got = [r[0] for r in df.select(X.to_double("v")).collect()]
    assert got == [0.0, 0.0, 0.0, 12.5, 1000.0, 7.0]
    keep_null = [r[0] for r in df.select(X.to_double("v", None)).collect()]
    assert keep_null == [None, None, None, 12.5, 1000.0, 7.0]


def test_target_to_int(spark):
    df = _one_col(spark, ["1", "0", None, "1.0", "abc", "0.9"])
    assert [r[0] for r in df.select(X.to_int_target("v")).collect()] == [1, 0, 0, 1, 0, 0]


def test_label_to_int(spark):
    df = _one_col(spark, [" YES ", "No", None, "yes", "y"])
    assert [r[0] for r in df.select(X.label_to_int("v")).collect()] == [1, 0, 0, 1, 0]


def test_blank_to_null(spark):
    df = _one_col(spark, ["", " ", None, "a"])
    assert [r[0] for r in df.select(X.blank_to_null("v")).collect()] == [None, " ", None, "a"]


def test_risk_band_on_rounded_probability(spark):
    ps = [0.39994, 0.39996, 0.4, 0.69996, 0.7, 0.5, 0.12345]
    df = _one_col(spark, ps, "p double")
    rows = df.select(X.round_prob("p").alias("r"), X.risk_band(X.round_prob("p")).alias("b"),
                     X.yes_no(F.col("p") > 0.5).alias("y")).collect()
    assert [r["r"] for r in rows] == [0.3999, 0.4, 0.4, 0.7, 0.7, 0.5, 0.1235]   # half up (T11)
    assert [r["b"] for r in rows] == ["Low", "Medium", "Medium", "High", "High", "Medium", "Low"]
    assert [r["y"] for r in rows] == ["No", "No", "No", "Yes", "Yes", "No", "No"]  # 0.5 is not > 0.5 (T13)


def test_nan_to_null(spark):
    df = _one_col(spark, [float("nan"), 1.5, None], "x double")
    assert [r[0] for r in df.select(X.nan_to_null("x")).collect()] == [None, 1.5, None]


def test_formats(spark):
    df = spark.createDataFrame([(1234567, 27.349, 12.25)], "n long, pct double, t double")
    r = df.select(X.fmt_count("n"), X.fmt_percent1("pct"), X.fmt_fixed1("t")).first()
    assert tuple(r) == ("1,234,567", "27.3%", "12.3")


def test_display_outcome(spark):
    df = spark.createDataFrame(
        [(0.734, None, None), (None, 64.0, "No"), (None, None, None), (0.2, None, "1")],
        "a double, b double, lab string")
    rows = df.select(X.display_percent("a", "b").alias("pct")).collect()
    assert [None if r[0] is None else round(r[0], 6) for r in rows] == [73.4, 64.0, None, 20.0]
    flags = df.select(X.display_outcome("lab", X.display_percent("a", "b"))).collect()
    assert [r[0] for r in flags] == [True, False, False, True]


def test_timestamps(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ '2024-03-05 07:08:09' AS ts")
    r = df.select(X.model_version_of("ts"), X.iso_utc("ts"), X.snapshot_time("ts")).first()
    assert tuple(r) == ("v20240305-070809", "2024-03-05T07:08:09Z", "2024-03-05 07:08:09")


def test_derived_flags_and_rules(spark):
    df = spark.createDataFrame([(29, 1, 2), (30, 0, 3), (65, 0, 10), (None, 0, None)],
                               "age int, churned int, tenure int")
    rows = df.select(X.under_30("age"), X.senior("age"), X.customer_status("churned", "tenure")).collect()
    assert [tuple(r) for r in rows] == [("Yes", "No", "Churned"), ("No", "No", "Joined"),
                                        ("No", "Yes", "Stayed"), (None, None, "Stayed")]
    svc = spark.createDataFrame([("No", "Yes"), ("No", "No"), ("Yes", "Yes"), ("No", None)], "base string, extra string")
    assert [r[0] for r in svc.select(X.breaks_dependency("base", "extra")).collect()] == [True, False, False, False]


def test_pair_compose_split(spark):
    df = spark.createDataFrame([(36.7, -119.7)], "a double, b double")
    r = df.select(X.compose_pair("a", "b").alias("p")).first()["p"]
    assert r == "36.7, -119.7"
    quoted = _one_col(spark, ['"36.7, -119.7"', "bad", None])
    rows = quoted.select(*X.split_pair("v")).collect()
    assert tuple(rows[0]) == (36.7, -119.7)
    assert rows[1][0] is None and rows[2][0] is None
    assert not math.isnan(rows[0][0])
