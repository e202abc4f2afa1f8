"""Property tests (SURVEY §5 (3)) with generated inputs; few examples each because every
example runs Spark jobs."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from churnspark.operators import analytics as A
from churnspark.operators import merge as M
from churnspark.operators import metrics as MT
from churnspark.operators import rows as R

from tests.test_rows import _brute_auc

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))

keys = st.integers(min_value=0, max_value=30)
vals = st.one_of(st.none(), st.integers(min_value=-5, max_value=5))


@SETTINGS
@given(old=st.lists(st.tuples(keys, vals), max_size=25, unique_by=lambda t: t[0]),
       new=st.lists(st.tuples(keys, vals, st.integers(0, 3)), max_size=25))
def test_upsert_properties(spark, old, new):
    t = spark.createDataFrame(old, "k int, v int")
    inc = spark.createDataFrame(new, "k int, v int, o int")
    once = M.upsert(t, inc.select("k", "v", "o"), "k", order=["o", "v"])
    twice = M.upsert(once, inc.select("k", "v", "o"), "k", order=["o", "v"])
    a = sorted(map(tuple, once.collect()), key=repr)
    assert a == sorted(map(tuple, twice.collect()), key=repr)                   # idempotent
    assert len({r[0] for r in a}) == len(a)                                      # keys unique
    assert {r[0] for r in a} == {k for k, _ in old} | {k for k, _, _ in new}     # no key lost
    last = {}
    for k, v, o in sorted(new, key=lambda t: (t[2], -99 if t[1] is None else t[1])):
        last[k] = v
    got = dict(a)
    assert all(got[k] == v for k, v in last.items())                            # last incoming wins
    for strategy in ("broadcast", "shuffle"):                                    # both plans agree
        other = M.upsert(t, inc.select("k", "v", "o"), "k", order=["o", "v"], strategy=strategy)
        assert sorted(map(tuple, other.collect()), key=repr) == a


@SETTINGS
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), vals), max_size=30))
def test_added_rows_of_itself_is_empty(spark, rows):
    df = spark.createDataFrame(rows, "s string, v int")
    assert M.added_rows(df, df).count() == 0
    assert M.except_all_rows(df, df).count() == 0


@SETTINGS
@given(xs=st.lists(st.one_of(st.none(), st.floats(-1e6, 1e6, allow_nan=False)), min_size=1, max_size=60),
       bins=st.integers(1, 40))
def test_histogram_counts_add_up(spark, xs, bins):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    h = A.histogram(df, "x", bins).toPandas()
    n = sum(x is not None for x in xs)
    assert int(h["count"].sum()) == n
    assert len(h) == (bins if n else 0) and sorted(h["bin"]) == (list(range(bins)) if n else [])


@SETTINGS
@given(xs=st.lists(st.integers(-1000, 1000), min_size=1, max_size=80), parts=st.integers(1, 7))
def test_row_ids_are_sorted_positions(spark, xs, parts):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x int")
    out = R.row_ids(df, ["x", "i"], num_partitions=parts).orderBy("row_id").toPandas()
    assert list(out.row_id) == list(range(1, len(xs) + 1))
    assert list(out.x) == sorted(xs)


@SETTINGS
@given(ys=st.lists(st.floats(-100, 100, allow_nan=False), min_size=1, max_size=60),
       p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 1.0]))
def test_exact_quantile_is_numpy(spark, ys, p):
    df = spark.createDataFrame([(y,) for y in ys], "y double")
    got = R.exact_quantiles(df, "y", [p], names=["q"]).first()
    assert got["n"] == len(ys)
    assert got["q"] == pytest.approx(float(np.quantile(ys, p)), abs=1e-9)


@SETTINGS
@given(pairs=st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=60))
def test_auc_is_brute_force_and_symmetric(spark, pairs):
    y = [a for a, _ in pairs]
    s = [b / 6 for _, b in pairs]
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    auc = MT.roc_auc(df, "y", "s", digits=None).first()[0]
    assert auc == pytest.approx(_brute_auc(y, s))
    if 0 < sum(y) < len(y):
        flipped = MT.roc_auc(df.withColumn("s", -F.col("s")), "y", "s", digits=None).first()[0]
        assert auc + flipped == pytest.approx(1.0)


@SETTINGS
@given(labels=st.lists(st.integers(0, 2), min_size=1, max_size=80))
def test_split_is_a_partition_of_the_right_size(spark, labels):
    df = spark.createDataFrame([(i, y) for i, y in enumerate(labels)], "id long, y int")
    out = R.stratified_split(df, "y", "id").toPandas()
    assert sorted(out.id) == list(range(len(labels)))
    assert (out.part == "test").sum() == math.ceil(0.2 * len(labels))
    for c, grp in out.groupby("y"):
        share = (grp.part == "test").sum()
        assert abs(share - 0.2 * len(grp)) <= 1.0 + 1e-9                # proportional up to rounding


@SETTINGS
@given(cells=st.lists(st.tuples(st.integers(0, 1), st.booleans()), min_size=1, max_size=50))
def test_confusion_cells_add_up(spark, cells):
    df = spark.createDataFrame(cells, "y int, p boolean")
    m = MT.binary_metrics(df, "y", "p").first()
    assert m.tp + m.fp + m.tn + m.fn == len(cells)
    assert 0.0 <= m.accuracy <= 1.0 and 0.0 <= m.f1 <= 1.0
