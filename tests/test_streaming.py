"""Structured Streaming jobs: stream result = batch result; replay changes nothing."""

import os

import numpy as np
import pandas as pd
import pytest

from churnspark import schema as S
from churnspark.ml import model as ML
from churnspark.operators import merge as M
from churnspark.sources import tables as TB
from churnspark.streaming import jobs as SJ

from tests.test_ml import _customers


@pytest.fixture(scope="module")
def small_model(spark):
    return ML.train(spark.createDataFrame(_customers(seed=21, n=300)), num_trees=8, max_depth=4).model


def test_continuous_scoring_equals_batch(spark, small_model, tmp):
    src = os.path.join(tmp, "incoming")
    os.makedirs(src)
    parts = [_customers(seed=31, n=20), _customers(seed=32, n=15)]
    parts[1]["customer_id"] = [f"D{i:05d}" for i in range(15)]
    for i, p in enumerate(parts):
        p.drop(columns=["churn_value"]).to_csv(os.path.join(src, f"part{i}.csv"), index=False)
    schema = spark.read.option("header", True).csv(os.path.join(src, "part0.csv")).schema
    log = os.path.join(tmp, "log")
    q = SJ.continuous_scoring(spark, src, schema, small_model, log, "v-test",
                              checkpoint=os.path.join(tmp, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(300)
    logged = spark.read.parquet(log).toPandas()
    batch = ML.score(small_model, spark.read.schema(schema).option("header", True).csv(src), "v-test").toPandas()
    assert len(logged) == 35 and logged.batch_id.nunique() == 2
    assert sorted(logged.inference_id) == list(range(1, 36))
    m = logged.merge(batch, on="customer_id")
    assert np.allclose(m.churn_probability_x.astype(float), m.churn_probability_y)


def test_continuous_upsert_replay(spark, tmp):
    src = os.path.join(tmp, "uploads")
    os.makedirs(src)
    header = ["customer_id", "city", "age", "monthly_charge"]
    pd.DataFrame([["1", "LA", "30", "10.5"], ["2", "SF", "", "20"], ["", "Nowhere", "1", "1"]],
                 columns=header).to_csv(os.path.join(src, "a.csv"), index=False)
    pd.DataFrame([["2", "Oakland", "45", ""], ["3", "SD", "50", "30"]],
                 columns=header).to_csv(os.path.join(src, "b.csv"), index=False)
    table = TB.VersionedTable(spark, os.path.join(tmp, "table"))
    q = SJ.continuous_upsert(spark, src, table, header, checkpoint=os.path.join(tmp, "ck1"), max_files_per_trigger=1)
    q.awaitTermination(300)
    got = table.read().select("customer_id", "city", "age", "monthly_charge").orderBy("customer_id").collect()
    assert [(r[0], r[1], r[2], None if r[3] is None else float(r[3])) for r in got] == \
        [("1", "LA", 30, 10.5), ("2", "Oakland", 45, None), ("3", "SD", 50, 30.0)]
    n_versions = table.versions().count()
    q2 = SJ.continuous_upsert(spark, src, table, header, checkpoint=os.path.join(tmp, "ck2"))
    q2.awaitTermination(300)
    assert table.versions().count() == n_versions                       # replay: no new version
    assert table.read().columns == [c for c, _, _ in S.CUSTOMER_COLUMNS]
    assert M.fingerprint(table.read()).first()["n_rows"] == 3


def test_bad_types_fail_the_batch(spark):
    bad = spark.createDataFrame([("1", "abc")], "customer_id string, age string")
    with pytest.raises(SJ.BatchTypeError):
        SJ.typed_upload(bad)


def test_log_batch_replay_is_idempotent(spark, tmp):
    from churnspark.sources import tables as TB
    log = os.path.join(tmp, "replay_log")
    rows = spark.createDataFrame([("a", 0.7, True), ("b", 0.2, False)],
                                 "customer_id string, churn_probability double, predicted_churn boolean")
    more = spark.createDataFrame([("c", 0.5, False)], "customer_id string, churn_probability double, predicted_churn boolean")
    assert TB.append_logs(spark, log, rows, "v1", batch_id=0) == 2
    assert TB.append_logs(spark, log, more, "v1", batch_id=1) == 1
    first = sorted(map(tuple, spark.read.parquet(log).select("inference_id", "customer_id", "batch_id").collect()))
    assert TB.append_logs(spark, log, more, "v1", batch_id=1) == 1            # the micro-batch is replayed
    again = sorted(map(tuple, spark.read.parquet(log).select("inference_id", "customer_id", "batch_id").collect()))
    assert first == again == [(1, "a", 0), (2, "b", 0), (3, "c", 1)]


def _write(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write(text)


def test_streams_read_by_column_name(spark, small_model, tmp):
    src = os.path.join(tmp, "swapped")
    _write(src, "a.csv", "customer_id,city,state\n1,LA,California\n")
    _write(src, "b.csv", "customer_id,state,city\n2,Texas,Paris\n")
    table = TB.VersionedTable(spark, os.path.join(tmp, "swapped_table"))
    SJ.continuous_upsert(spark, src, table, checkpoint=os.path.join(tmp, "ck")).awaitTermination(300)
    assert sorted((r.customer_id, r.city, r.state) for r in table.read().collect()) == [("1", "LA", "California"), ("2", "Paris", "Texas")]
    rows = _customers(seed=41, n=12).drop(columns=["churn_value"])
    first, second = os.path.join(tmp, "first"), os.path.join(tmp, "second")
    for folder, cols in ((first, list(rows.columns)), (second, list(rows.columns)[::-1])):
        os.makedirs(folder)
        rows[cols].to_csv(os.path.join(folder, "x.csv"), index=False)
    schema = spark.read.option("header", True).csv(first).schema
    logs = []
    for folder in (first, second):
        SJ.continuous_scoring(spark, folder, schema, small_model, folder + "_log", "v", checkpoint=folder + "_ck").awaitTermination(300)
        logs.append(sorted((r.customer_id, r.churn_probability) for r in spark.read.parquet(folder + "_log").collect()))
    assert logs[0] == logs[1] and len(logs[0]) == 12


def test_bad_files_are_quarantined_and_the_stream_goes_on(spark, tmp, monkeypatch):
    src = os.path.join(tmp, "mixed")
    _write(src, "a.csv", "customer_id,age\n1,30\n")
    _write(src, "b.csv", "customer_id,age\n2,many\n3,40\n")               # a value that is no number
    _write(src, "c.csv", "city,age\nLA,1\n")                              # no key
    _write(src, "d.csv", "customer_id,age\n4,50,extra\n")                 # a shifted row
    _write(src, "e.csv", "customer_id,gender\n5," + "x" * 500 + "\n")     # too long
    _write(src, "f.csv", "age,customer_id\n60,6\n")
    table = TB.VersionedTable(spark, os.path.join(tmp, "mixed_table"), settle_seconds=0)
    ck = os.path.join(tmp, "ck")

    def dies(*a, **k):
        raise RuntimeError("driver lost")

    # lost between the data and the catalog: the restarted stream replays the batch
    with monkeypatch.context() as m:
        m.setattr(TB.VersionedTable, "_record", dies)
        with pytest.raises(Exception):
            SJ.continuous_upsert(spark, src, table, checkpoint=ck).awaitTermination(300)
    SJ.continuous_upsert(spark, src, table, checkpoint=ck).awaitTermination(300)
    assert sorted((r.customer_id, r.age) for r in table.read().collect()) == [("1", 30), ("6", 60)]
    dead = spark.read.parquet(os.path.join(tmp, "mixed_table", "_quarantine")).collect()
    assert sorted(os.path.basename(r.file) for r in dead) == ["b.csv", "c.csv", "d.csv", "e.csv"]
    _write(src, "g.csv", "customer_id,age\n7,70\n")
    SJ.continuous_upsert(spark, src, table, checkpoint=ck).awaitTermination(300)
    assert table.read().count() == 3 and table.latest_version() == 2
