"""Analytics operators on literal rows and against brute force (FIXTURES §7: filter,
groups, histogram, correlation, box)."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnspark.operators import analytics as A
from churnspark.operators import clean as C
from churnspark.plans import charts as CH


@pytest.fixture()
def cust(spark):
    return spark.createDataFrame(
        [("1", "Month-to-month", "Yes", 1, 10.0, 100), ("2", "One year", None, 0, 20.0, 200),
         ("3", None, "No", 0, None, 300), ("4", "Month-to-month", "No", 1, 40.0, None),
         ("5", "Two year", "Yes", 0, None, 500)],
        "customer_id string, contract string, dependents string, churn_value int, charge double, cltv int")


def test_filter_null_and_empty_choice(cust):
    assert C.filter_in(cust, {}).count() == 5
    assert C.filter_in(cust, {"contract": [], "dependents": None}).count() == 5    # empty choice = no filter
    got = C.filter_in(cust, {"contract": ["Month-to-month", "One year", "Two year"]})
    assert sorted(r[0] for r in got.select("customer_id").collect()) == ["1", "2", "4", "5"]   # NULL never matches
    both = C.filter_in(cust, {"contract": ["Month-to-month"], "dependents": ["No"], "absent_col": ["x"]})
    assert [r[0] for r in both.select("customer_id").collect()] == ["4"]


def test_kpi_and_empty(spark, cust):
    k = A.kpi_overview(cust, cltv="cltv", tenure="charge").first()
    assert k["customers"] == 5 and k["churn_rate_pct"] == pytest.approx(40.0)
    assert k["avg_cltv"] == pytest.approx(275.0) and k["avg_tenure"] == pytest.approx(70 / 3)
    empty = A.kpi_overview(cust.filter("false"), cltv="cltv", tenure="charge").first()
    assert tuple(empty) == (0, 0.0, 0.0, 0.0)


def test_group_aggregations_null_key_and_all_null_group(cust):
    rates = {r[0]: r[1] for r in A.rate_by(cust, "contract").collect()}
    assert rates == {"Month-to-month": 100.0, "One year": 0.0, "Two year": 0.0}       # NULL key dropped
    s = {r[0]: r[1] for r in A.group_agg(cust, "contract", "charge", "sum").collect()}
    assert s == {"Month-to-month": 50.0, "One year": 20.0, None: 0.0, "Two year": 0.0}  # all-NULL group -> 0
    c = {r[0]: r[1] for r in A.group_agg(cust, "contract", "charge", "count").collect()}
    assert c == {"Month-to-month": 2, "One year": 1, None: 0, "Two year": 0}
    m = {r[0]: r[1] for r in A.group_agg(cust, "contract", "charge", "mean").collect()}
    assert m["Month-to-month"] == 25.0 and m["Two year"] is None
    assert A.group_agg(cust.filter("false"), "contract", "charge", "max").count() == 0
    with pytest.raises(ValueError):
        A.group_agg(cust, "contract", "charge", "median")
    shares = {r["contract"]: r["share"] for r in A.category_share(cust, "contract", "charge").collect()}
    assert shares["Month-to-month"] == pytest.approx(50 / 70)


def test_histogram_edges(spark):
    vals = [1.0, 2.0, 2.5, 10.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    h = A.histogram(df, "x", bins=3).orderBy("bin").collect()
    assert [r["count"] for r in h] == [3, 0, 1]                  # value = max in last bin; empty bin present
    assert h[0]["bin_lo"] == 1.0 and h[-1]["bin_hi"] == pytest.approx(10.0)
    same = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    hs = A.histogram(same, "x", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in hs] == [2, 0, 0, 0]              # min = max
    g = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 3.0), (None, 2.0)], "g string, x double")
    hg = A.histogram(g, "x", bins=2, group="g")
    assert hg.count() == 6                                      # every (group, bin), NULL group kept
    assert hg.agg(F.sum("count")).first()[0] == 4


def test_histogram_counts_add_up(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=500)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    h = A.histogram(df, "x", bins=30).toPandas()
    assert h["count"].sum() == 500 and len(h) == 30
    ref, _ = np.histogram(x, bins=30)
    assert abs(int(np.abs(h.sort_values("bin")["count"].to_numpy() - ref).sum())) <= 2   # float edges only


def test_box_stats_match_pandas(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", None], size=400), "y": rng.exponential(size=400)})
    pdf.loc[::17, "y"] = None
    df = spark.createDataFrame(pdf)
    got = A.box_stats(df, "y", "g").toPandas()
    for _, row in got.iterrows():
        sub = pdf[(pdf.g == row.g) if row.g is not None else pdf.g.isna()]["y"].dropna()
        q1, med, q3 = sub.quantile([0.25, 0.5, 0.75])
        assert row.q1 == pytest.approx(q1) and row["median"] == pytest.approx(med) and row.q3 == pytest.approx(q3)
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
        assert row.whisker_low == pytest.approx(sub[sub >= lo].min())
        assert row.whisker_high == pytest.approx(sub[sub <= hi].max())
        assert row.n_outliers == int(((sub < lo) | (sub > hi)).sum())
    out = A.box_outliers(df, "y", "g")
    assert out.count() == int(got["n_outliers"].sum())
    whole = A.box_stats(df, "y").first()
    assert whole["median"] == pytest.approx(pdf["y"].dropna().median())
    assert A.box_stats(df.filter("y < 0"), "y").count() == 0 and A.box_stats(df.filter("y < 0"), "y", "g").count() == 0


def test_corr_matrix(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0, None], "b": [2.0, 4.1, 6.2, 7.9, 1.0],
                        "c": [1.0, 1.0, 1.0, 1.0, 1.0]})
    df = spark.createDataFrame(pdf)
    got = {(r.a, r.b): r.r for r in A.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert len(got) == 9
    assert got[("a", "b")] == pytest.approx(pdf[["a", "b"]].corr().loc["a", "b"])   # pairwise complete
    assert got[("a", "b")] == got[("b", "a")] and got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "c")] is None and got[("c", "c")] is None                      # constant: NULL, no error
    with pytest.raises(ValueError):
        A.corr_matrix(df, ["a"])


def test_filter_options_and_classes(spark, cust):
    opts = [tuple(r) for r in A.filter_options(cust, ["contract", "dependents"]).collect()]
    assert opts == [("contract", "Month-to-month"), ("contract", "One year"), ("contract", "Two year"),
                    ("dependents", "No"), ("dependents", "Yes")]
    w = {r["churn_value"]: r["weight"] for r in A.class_weights(cust, "churn_value").collect()}
    assert w[0] == pytest.approx(5 / (2 * 3)) and w[1] == pytest.approx(5 / (2 * 2))
    bal = {r["churn_value"]: r["share_pct"] for r in A.class_balance(cust, "churn_value").collect()}
    assert bal == {0: 60.0, 1: 40.0}


def test_chart_specs(spark, cust):
    assert CH.run_chart(cust, CH.ChartSpec("bar", x="contract", y="charge", aggregation="max")).count() == 4
    assert CH.run_chart(cust, CH.ChartSpec("scatter", x="charge", y="cltv", color="contract")).count() == 5
    assert CH.run_chart(cust, CH.ChartSpec("heatmap", columns=["charge", "cltv", "contract"])).count() == 4
    with pytest.raises(ValueError):
        CH.run_chart(cust, CH.ChartSpec("heatmap", columns=["charge"]))
    with pytest.raises(ValueError):
        CH.run_chart(cust, CH.ChartSpec("histogram", x="charge", bins=3))
    assert C.numeric_columns(cust) == ["churn_value", "charge", "cltv"]


def test_sorted_groups_null_last(spark, cust):
    g = A.group_agg(cust, "contract", "charge", "count")
    assert [r[0] for r in A.sorted_groups(g, "contract").collect()] == \
        ["Month-to-month", "One year", "Two year", None]


def test_dashboard_overview_shares_one_filtered_frame(spark, cust):
    from churnspark.plans import dashboard as DB
    df = cust.withColumn("churn_label", F.when(F.col("churn_value") == 1, "Yes").otherwise("No")) \
             .withColumn("internet_service", F.col("dependents")).withColumn("tenure_in_months", F.col("cltv") / 10) \
             .withColumn("monthly_charge", F.col("charge"))
    ov = DB.overview(df, {"contract": ["Month-to-month", "One year"]}, bins=5)
    assert ov.filtered.is_cached
    assert ov.kpis.first()["customers"] == 3
    assert {r[0] for r in ov.rate_by_contract.collect()} == {"Month-to-month", "One year"}
    assert ov.tenure_histogram.count() == 10                    # 2 labels x 5 bins
    assert ov.long_form().filter("panel = 'monthly_box'").count() == 2
    ov.release()
    assert not ov.filtered.is_cached
