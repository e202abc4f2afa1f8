"""Distributed positions, quantiles, split and evaluation against brute force
(FIXTURES §7: metrics; SURVEY §5 properties)."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from churnspark.operators import metrics as MT
from churnspark.operators import rows as R


def test_row_ids_many_partitions(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5000).repartition(13)
    out = R.row_ids(df, ["k"], num_partitions=9).select("k", "row_id").toPandas()
    assert sorted(out.row_id) == list(range(1, 5001))
    assert (out.sort_values("k").row_id.to_numpy() == np.arange(1, 5001)).all()


def test_positions_with_hot_group(spark):
    rows = [("hot", i) for i in range(4000)] + [("a", i) for i in range(5)] + [(None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, v int").repartition(7)
    out = R.positions(df, ["v"], ["g"], name="pos", size_name="n", num_partitions=6).toPandas()
    for g, sub in out.groupby(out.g.fillna("<null>")):
        sub = sub.sort_values("v")
        assert (sub.pos.to_numpy() == np.arange(1, len(sub) + 1)).all()
        assert (sub.n == len(sub)).all()


def test_running_sum(spark):
    pdf = pd.DataFrame({"s": np.arange(300, dtype=float)[::-1], "w": np.arange(300) % 4})
    out = R.running_sum(spark.createDataFrame(pdf).repartition(5), ["s"], "w", num_partitions=4).toPandas()
    out = out.sort_values("s")
    assert (out.running.to_numpy() == out.w.cumsum().to_numpy()).all()


def test_exact_quantiles_vs_numpy(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 999), "y": rng.normal(size=999)})
    got = R.exact_quantiles(spark.createDataFrame(pdf), "y", [0.1, 0.5, 0.9], ["g"]).toPandas()
    for _, row in got.iterrows():
        ys = pdf[pdf.g == row.g].y
        assert row.n == len(ys)
        for p, name in [(0.1, "q10"), (0.5, "q50"), (0.9, "q90")]:
            assert row[name] == pytest.approx(np.quantile(ys, p))


@pytest.mark.parametrize("finish", [0, 10 ** 6])
def test_selection_of_awkward_values(spark, monkeypatch, finish):
    """Heavy tails, ties, infinities, huge ranges: bucket passes alone, mixed and counts alone."""
    monkeypatch.setattr(R, "SELECT_FINISH", finish)
    monkeypatch.setattr(R, "SELECT_BUCKETS", 512)
    rng = np.random.default_rng(11)
    groups = {"tail": np.exp(rng.normal(0, 60, 300)), "left": -np.exp(rng.normal(0, 60, 300)), "tied": np.repeat([1.0, 2.0], [250, 50]),
              "inf": np.array([-np.inf, -1e308, 0.0, -0.0, 5e-324, 1e308, np.inf] * 7), "one": np.array([3.5]),
              "huge": rng.uniform(-8e307, 8e307, 200) * 2, None: rng.normal(size=77)}
    rows = [(g, float(y)) for g, ys in groups.items() for y in ys] + [("none", None), ("tail", None)]
    df = spark.createDataFrame(rows, "g string, y double").repartition(5)
    n = F.col("n")
    got = R.select_ranks(df, "y", [F.lit(0), n - 1, F.floor(n / 2), F.floor(n / 3)], ["g"]).collect()
    want = {(g, t): np.sort(ys)[k] for g, ys in groups.items() for t, k in enumerate([0, len(ys) - 1, len(ys) // 2, len(ys) // 3])}
    assert len(got) == len(want) and {(r.g, r.t): r.y for r in got} == want
    whole = np.sort(np.concatenate(list(groups.values())))
    assert [r.y for r in R.select_ranks(df, "y", [F.floor(n / 4)]).collect()] == [whole[len(whole) // 4]]
    assert R.select_ranks(df.filter("y > 2 and y < 1"), "y", [F.lit(0)], ["g"]).count() == 0
    R.release_caches()


def test_stratified_split_properties(spark):
    lab = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1001)], "id long, y int")
    s1 = R.stratified_split(lab, "y", "id").toPandas()
    s2 = R.stratified_split(lab.repartition(11), "y", "id").toPandas()
    assert len(s1) == 1001 and set(s1.part) == {"train", "test"}
    assert (s1.part == "test").sum() == 201                                   # ceil(0.2 * 1001)
    by = s1[s1.part == "test"].groupby("y").size().to_dict()
    assert by == {0: 151, 1: 50}            # 150.6 + 50.4: floor, the remainder goes to the larger fraction
    m = s1.merge(s2, on=["id", "y"])
    assert (m.part_x == m.part_y).all()                                        # stable under repartition
    one = spark.createDataFrame([(i, 0) for i in range(10)], "id long, y int")
    assert (R.stratified_split(one, "y", "id").toPandas().part == "test").sum() == 2


def _brute_auc(y, s):
    pos = [si for yi, si in zip(y, s) if yi == 1]
    neg = [si for yi, si in zip(y, s) if yi != 1]
    if not pos or not neg:
        return 0.0
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_roc_auc_exact_with_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.round(rng.random(400) * 0.5 + y * 0.3, 2)            # many ties
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    auc = MT.roc_auc(df, "y", "s", digits=None).first()[0]
    assert auc == pytest.approx(_brute_auc(y, s))
    flipped = MT.roc_auc(df.withColumn("s", 1 - F.col("s")), "y", "s", digits=None).first()[0]
    assert auc + flipped == pytest.approx(1.0)
    one = spark.createDataFrame([(1, 0.3), (1, 0.6)], "y int, s double")
    assert MT.roc_auc(one, "y", "s").first()[0] == 0.0


def test_binary_metrics_edges(spark):
    df = spark.createDataFrame([(1, False), (0, False), (1, False)], "y int, p boolean")
    m = MT.binary_metrics(df, "y", "p").first()
    assert (m.tp, m.fp, m.tn, m.fn) == (0, 0, 1, 2)
    assert m.precision == 0.0 and m.recall == 0.0 and m.f1 == 0.0            # no predicted positive
    assert m.accuracy == pytest.approx(round(1 / 3, 4))
    assert m.tp + m.fp + m.tn + m.fn == 3


def test_zscore_and_slots(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "a"), (None, None), (4.0, "c"), (5.0, "b")],
                               "x double, c string")
    z = [r[0] for r in MT.zscore(df, ["x"]).select("x_z").collect()]
    ref = (np.array([1, 2, 3, 4, 5.0]) - 3.0) / np.std([1, 2, 3, 4, 5.0])
    assert [v for v in z if v is not None] == pytest.approx(list(ref))
    const = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert [r[0] for r in MT.zscore(const, ["x"]).select("x_z").collect()] == [None, None]
    slots = {(r.value): r.slot for r in MT.category_slots(df, ["c"]).collect()}
    assert slots == {"a": 0, "b": 1, "c": 2}
