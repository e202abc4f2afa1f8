"""One key holding a third of all rows (the brief's skew assumption): results stay exact."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnspark.operators import analytics as A
from churnspark.operators import merge as M
from churnspark.operators import rows as R

N = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(17)
    keys = np.where(np.arange(N) < N // 3, 0, rng.integers(1, 500, N))      # key 0 holds a third
    pdf = pd.DataFrame({"k": keys, "seq": np.arange(N), "y": rng.normal(size=N).round(6),
                        "g": np.where(keys == 0, "hot", "cold")})
    return pdf, spark.createDataFrame(pdf).repartition(8)


def test_merge_and_dedup_with_hot_key(spark, skewed):
    pdf, df = skewed
    a = df.select("k", "seq", F.col("y").alias("ya"))
    b = df.filter("k % 2 = 0").select("k", "seq", F.col("g").alias("gb"))
    out = M.merge_sources([a, b], "k", orders=[["seq"], ["seq"]]).toPandas().set_index("k")
    last = pdf.sort_values("seq").groupby("k").last()
    assert len(out) == pdf.k.nunique()
    assert np.allclose(out.loc[last.index, "ya"], last.y)
    assert out.loc[0, "gb"] == "hot"


def test_upsert_with_hot_incoming_key(spark, skewed):
    pdf, df = skewed
    table = spark.createDataFrame([(0, -1.0), (9999, 5.0)], "k long, y double")
    out = {r.k: r.y for r in M.upsert(table, df.select("k", "y", "seq"), "k", order=["seq"]).collect()}
    assert out[0] == pytest.approx(pdf[pdf.k == 0].sort_values("seq").y.iloc[-1])
    assert out[9999] == 5.0 and len(out) == pdf.k.nunique() + 1


def test_ranks_and_quantiles_in_hot_group(spark, skewed):
    pdf, df = skewed
    ranked = R.positions(df, ["y", "seq"], ["g"], name="r", size_name="n", num_partitions=8).toPandas()
    for g, sub in ranked.groupby("g"):
        assert sorted(sub.r) == list(range(1, len(sub) + 1)) and (sub.n == len(sub)).all()
    box = A.box_stats(df, "y", "g").toPandas().set_index("g")
    for g, sub in pdf.groupby("g"):
        q1, q3 = sub.y.quantile([0.25, 0.75])
        assert box.loc[g, "q1"] == pytest.approx(q1) and box.loc[g, "q3"] == pytest.approx(q3)


def test_quantiles_of_tied_values(spark):
    """Nine rows in ten share one value: counts are summed map-side, so it is a row per task."""
    pdf = pd.DataFrame({"y": np.where(np.arange(N) % 10 < 9, 0.0, np.arange(N) / 7.0)})
    df = spark.createDataFrame(pdf).repartition(8)
    row = A.box_stats(df, "y").first()
    assert row.n == N and row["median"] == 0.0 and row.q3 == pdf.y.quantile(0.75)
    assert row.n_outliers == int((pdf.y > 0).sum())


def test_histogram_and_added_rows_with_hot_group(spark, skewed):
    pdf, df = skewed
    h = A.histogram(df, "y", 20, group="g").groupBy("g").agg(F.sum("count").alias("n")).toPandas()
    assert dict(zip(h.g, h.n)) == pdf.groupby("g").size().to_dict()
    dup = df.select("g").filter("g = 'hot'")                                  # 2000 identical rows
    assert M.added_rows(dup, dup.limit(1)).count() == 0
    assert M.except_all_rows(dup, dup.limit(1)).count() == N // 3 - 1
