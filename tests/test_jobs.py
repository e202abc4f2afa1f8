"""Composed jobs on hand-written files (FIXTURES §3-§5, §7)."""

import os

import pandas as pd
import pytest

from churnspark import schema as S
from churnspark.plans import jobs as J
from churnspark.sources.tables import VersionedTable
from churnspark.streaming.jobs import BatchTypeError

from tests.test_ml import _customers


def _write(path, header, rows):
    pd.DataFrame(rows, columns=header).to_csv(path, index=False)
    return path


def test_ingest_topics(spark, tmp):
    p = {}
    p["location"] = _write(os.path.join(tmp, "loc.csv"), list(S.LOCATION_MAP),
                           [["A", "United States", "California", "LA", 90001, "34.0, -118.2", 34.0, -118.2],
                            ["B", "United States", "California", "SF", 94016, "37.7, -122.4", 37.7, -122.4]])
    p["demographics"] = _write(os.path.join(tmp, "demo.csv"), list(S.DEMOGRAPHICS_MAP),
                               [["A", "Female", 40, "No", "No", "Yes", "No", 0],
                                ["C", "Male", 70, "No", "Yes", "No", "No", 0]])
    svc_header = list(S.SERVICES_MAP)
    svc = lambda cid, tenure, contract, charge: [cid, tenure, "Yes", "No", "Yes", "DSL", "No", "No", "No", "No",
                                                  "No", "No", contract, "Yes", "Mailed check", charge, charge * tenure]
    p["services"] = _write(os.path.join(tmp, "svc.csv"), svc_header,
                           [svc("A", 1, "Month-to-month", 29.85), svc("A", 2, "One year", 30.0)])   # two quarters
    p["status"] = _write(os.path.join(tmp, "status.csv"), list(S.STATUS_MAP),
                         [["A", 3, "Stayed", "No", 0, 40, 5000, None, None],
                          ["B", 1, "Churned", "Yes", 1, 90, 2000, "Price", "Too expensive"]])
    table = VersionedTable(spark, os.path.join(tmp, "customers"))
    v = J.ingest_topics(spark, p, table)
    df = table.read(v)
    assert df.columns == [c for c, _, _ in S.CUSTOMER_COLUMNS]
    rows = {r.customer_id: r for r in df.collect()}
    assert set(rows) == {"A", "B", "C"}
    a = rows["A"]
    assert (a.city, a.gender, a.partner, a.tenure_in_months, a.contract) == ("LA", "Female", "Yes", 2, "One year")
    assert a.zip_code == "90001" and float(a.monthly_charge) == 30.0
    assert rows["B"].gender is None and rows["B"].churn_value == 1 and rows["C"].city is None
    assert J.ingest_topics(spark, p, table) == v + 1                    # re-run is an idempotent upsert
    assert sorted(map(tuple, table.read().collect())) == sorted(map(tuple, df.collect()))


def test_upload_csv(spark, tmp):
    table = VersionedTable(spark, os.path.join(tmp, "t"))
    path = _write(os.path.join(tmp, "up.csv"), ["customer_id", "city", "age", "churn_value"],
                  [["X1", "LA", "30", "0"], ["", "Nowhere", "1", "0"], ["X2", "SF", "", "1"],
                   ["X1", "Oakland", "31", "0"]])
    res = J.upload_csv(spark, path, table)
    assert {r.status: r.n for r in res.summary.collect()} == {"saved": 3, "error": 1}
    assert [tuple(r) for r in res.errors.collect()] == [(3, "customer_id is required")]
    assert [tuple(r) for r in res.saved.orderBy("row").collect()] == [(2, "X1"), (4, "X2"), (5, "X1")]
    got = {r.customer_id: (r.city, r.age) for r in table.read().collect()}
    assert got == {"X1": ("Oakland", 31), "X2": ("SF", None)}           # last row of a key wins
    # "30.0" is not an integer either (the database rejects it as well)
    bad = _write(os.path.join(tmp, "bad.csv"), ["customer_id", "age"], [["X3", "abc"], ["X4", "30.0"]])
    with pytest.raises(BatchTypeError):
        J.upload_csv(spark, bad, table)
    assert table.latest_version() == res.version                        # nothing written


def test_train_and_score_file(spark, tmp):
    table = VersionedTable(spark, os.path.join(tmp, "cust"))
    table.publish(spark.createDataFrame(_customers(seed=41, n=300)))
    meta = J.train_from_table(table, os.path.join(tmp, "models"), num_trees=10, max_depth=5)
    assert meta["n_train_rows"] + meta["n_test_rows"] == 300
    score_pdf = _customers(seed=42, n=25, snake=False).drop(columns=["Churn Value"])
    score_pdf = score_pdf.rename(columns={"Monthly Charges": "monthly_charges"})   # alias accepted
    path = os.path.join(tmp, "to_score.csv")
    score_pdf.to_csv(path, index=False)
    out = J.score_file(spark, path, os.path.join(tmp, "models"), out_path=os.path.join(tmp, "out"),
                       log_path=os.path.join(tmp, "log"))
    assert out.count() == 25
    assert spark.read.parquet(os.path.join(tmp, "log")).count() == 25
    exported = spark.read.option("header", True).csv(os.path.join(tmp, "out"))
    assert exported.count() == 25 and exported.columns[0] == "customer_id"
    status = J.score_file(spark, path, os.path.join(tmp, "models"), with_status=True)
    assert status.filter("status = 'OK'").count() == 25


def test_upload_with_quoted_line_feeds(spark, tmp):
    path = os.path.join(tmp, "notes.csv")
    with open(path, "w") as f:
        f.write('churn_reason,customer_id\n"two\nlines",1\nplain,2\n')
    table = VersionedTable(spark, os.path.join(tmp, "notes_table"))
    with pytest.raises(Exception):
        J.upload_csv(spark, path, table)
    J.upload_csv(spark, path, table, multiline=True)
    assert sorted((r.customer_id, r.churn_reason) for r in table.read().collect()) == [("1", "two\nlines"), ("2", "plain")]
