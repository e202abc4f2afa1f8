"""Merge family on literal rows (FIXTURES §7: outer merge, dedup, upsert, versions)."""

import random

import pytest

from churnspark.operators import merge as M


def _rows(df, order="customer_id"):
    return [tuple(r) for r in df.orderBy(order).collect()]


@pytest.mark.parametrize("strategy", ["aggregate", "join"])
def test_outer_merge_keeps_every_key(spark, strategy):
    loc = spark.createDataFrame([("a", "LA"), ("b", "SF"), ("c", "SD")], "customer_id string, city string")
    demo = spark.createDataFrame([("a", "F"), ("d", "M")], "customer_id string, gender string")
    svc = spark.createDataFrame([("a", 1, "Q1", 10.0), ("a", 2, "Q2", 20.0), ("b", 1, "Q1", 5.0)],
                                "customer_id string, q int, quarter string, charge double")
    st = spark.createDataFrame([("a", 1), ("c", 0)], "customer_id string, churn_value int")
    out = M.merge_sources([loc, demo, svc, st], "customer_id", orders=[None, None, ["q"], None], strategy=strategy)
    assert out.columns == ["customer_id", "city", "gender", "quarter", "charge", "churn_value"]
    assert _rows(out) == [("a", "LA", "F", "Q2", 20.0, 1),      # in all four; last service row wins
                          ("b", "SF", None, "Q1", 5.0, None),   # in two
                          ("c", "SD", None, None, None, 0),
                          ("d", None, "M", None, None, None)]   # in one only


@pytest.mark.parametrize("strategy", ["aggregate", "join"])
def test_merge_of_some_columns_gives_the_same_rows(spark, strategy):
    rnd = random.Random(11)
    # ties in the order, repeated keys, null keys and null values
    def rows(n):
        return [(rnd.choice([None, "a", "b", "c", "d"]), rnd.randrange(2), rnd.choice([None, 1, 2, 3]),
                 rnd.choice([None, "x", "y"]), rnd.choice([None, 0.5, 1.5])) for _ in range(n)]

    one = spark.createDataFrame(rows(40), "k string, seq int, p int, q string, r double")
    two = spark.createDataFrame(rows(3), "k string, seq int, s int, t string, u double")

    def merge(**kw):
        return M.merge_sources([one, two], "k", orders=[["seq"], None], strategy=strategy, **kw)

    every = [c for c in merge().columns if c != "k"]
    for wanted in [[], ["p"], ["q"], ["r", "s"], ["u"], ["seq"], every]:
        names = ["k", *[c for c in every if c in wanted]]
        out = merge(columns=wanted)
        assert out.columns == names
        assert sorted(map(repr, out.collect())) == sorted(map(repr, merge().select(*names).collect()))
    with pytest.raises(ValueError):
        merge(columns=["nowhere"])


def test_merge_without_ties_carries_only_the_columns_asked_for(spark, tmp):
    for name, cols in (("one", "id AS k, id AS seq, id AS p, uuid() AS q"), ("two", "id AS k, uuid() AS s")):
        spark.range(50).selectExpr(*[c.strip() for c in cols.split(",")]).write.parquet(f"{tmp}/{name}")
    one, two = (spark.read.parquet(f"{tmp}/{x}") for x in ("one", "two"))
    out = M.merge_sources([one, two], "k", orders=[["seq"], None], columns=["q"], no_ties=True)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<k:bigint,seq:bigint,q:string>" in plan and "ReadSchema: struct<k:bigint>" in plan
    assert out.count() == 50


def test_merge_rejects_overlapping_columns(spark):
    a = spark.createDataFrame([("a", 1)], "customer_id string, x int")
    with pytest.raises(ValueError):
        M.merge_sources([a, a], "customer_id")


def test_dedup_last_with_hot_key(spark):
    rows = [("hot", i, f"v{i}") for i in range(3000)] + [("cold", 1, "c1"), ("cold", 0, "c0")]
    df = spark.createDataFrame(rows, "k string, seq int, v string").repartition(8)
    out = {r["k"]: r["v"] for r in M.dedup_last(df, "k", ["seq"]).collect()}
    assert out == {"hot": "v2999", "cold": "c1"}


@pytest.fixture()
def table(spark):
    return spark.createDataFrame(
        [("1", "LA", 10.0, "Yes"), ("2", "SF", 20.0, "No"), ("3", "SD", None, "No")],
        "customer_id string, city string, charge double, churn_label string")


def test_upsert_cases(spark, table):
    incoming = spark.createDataFrame(
        [("2", None, 1, "extra"), ("4", 40.0, 1, "x"), ("4", 41.0, 2, "y"), ("3", 30.0, 1, "z")],
        "customer_id string, charge double, seq int, unknown string")
    out = M.upsert(table, incoming, "customer_id", order=["seq"])
    assert out.columns == table.columns                        # unknown column ignored
    assert _rows(out) == [("1", "LA", 10.0, "Yes"),            # untouched
                          ("2", "SF", None, "No"),             # blank overwrites (T1, source behaviour)
                          ("3", "SD", 30.0, "No"),             # fewer columns: the others kept
                          ("4", None, 41.0, None)]             # new key; repeated key -> last wins
    keep = M.upsert(table, incoming, "customer_id", blanks="keep", order=["seq"])
    assert _rows(keep)[1] == ("2", "SF", 20.0, "No")


def test_upsert_is_idempotent_and_keys_unique(spark, table):
    incoming = spark.createDataFrame([("2", 99.0), ("9", 1.0)], "customer_id string, charge double")
    once = M.upsert(table, incoming, "customer_id")
    twice = M.upsert(once, incoming, "customer_id")
    assert _rows(once) == _rows(twice)
    assert once.groupBy("customer_id").count().filter("count > 1").count() == 0


def test_type_errors(spark):
    inc = spark.createDataFrame([("1", "12", "abc"), ("2", None, "3")], "customer_id string, age string, cltv string")
    bad = M.type_errors(inc, {"age": "int", "cltv": "int"}, "customer_id").collect()
    assert [tuple(r) for r in bad] == [("1", "cltv", "abc")]


def test_update_delete_insert_ignore(spark, table):
    upd = spark.createDataFrame([("1", "Oakland"), ("7", "Nowhere")], "customer_id string, city string")
    new, missing = M.update(table, upd, "customer_id")
    assert _rows(new)[0] == ("1", "Oakland", 10.0, "Yes")
    assert [r[0] for r in missing.collect()] == ["7"]
    with pytest.raises(ValueError):
        M.update(table, spark.createDataFrame([("1",)], "customer_id string"), "customer_id")
    keys = spark.createDataFrame([("2",), ("8",)], "customer_id string")
    kept, not_found = M.delete(table, keys, "customer_id")
    assert [r[0] for r in kept.orderBy("customer_id").collect()] == ["1", "3"]
    assert [r[0] for r in not_found.collect()] == ["8"]
    seed = spark.createDataFrame([("1", "Other"), ("5", "New")], "customer_id string, city string")
    ins = M.insert_ignore(table, seed, "customer_id")
    assert _rows(ins) == [("1", "LA", 10.0, "Yes"), ("2", "SF", 20.0, "No"), ("3", "SD", None, "No"),
                          ("5", "New", None, None)]


def test_version_differences(spark):
    v1 = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y"), ("c", 3, "y")], "k string, n int, s string")
    v2 = spark.createDataFrame([("a", 1, None), ("b", 5, "x"), ("c", 3, "y"), ("d", 4, None), ("d", 4, None)],
                               "k string, n int, s string")
    added = sorted(tuple(r) for r in M.added_rows(v2, v1).collect())
    assert added == [("b", 5, "x"), ("d", 4, None), ("d", 4, None)]      # NULL == NULL, duplicates kept
    removed = sorted(tuple(r) for r in M.removed_rows(v2, v1).collect())
    assert removed == [("b", 2, "x")]
    bag = sorted(tuple(r) for r in M.except_all_rows(v1, v2).collect())
    assert bag == [("b", 2, "x"), ("c", 3, "y")]                         # bag difference
    assert M.added_rows(v1, v1).count() == 0


def test_fingerprint_is_order_free(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "n int, s string")
    b = spark.createDataFrame([(2, None), (1, "x")], "n int, s string").repartition(3)
    c = spark.createDataFrame([(1, None), (2, "x")], "n int, s string")
    fa, fb, fc = (M.fingerprint(x).first() for x in (a, b, c))
    assert fa == fb
    assert fa["row_hash_sum"] != fc["row_hash_sum"]


@pytest.mark.parametrize("fn", ["upsert", "update", "delete", "insert_ignore"])
def test_small_batch_path_equals_shuffle_path(spark, table, fn):
    batch = spark.createDataFrame([("2", None, 1), ("4", 40.0, 1), ("4", 41.0, 2), (None, 5.0, 1)],
                                  "customer_id string, charge double, seq int")
    def run(strategy):
        if fn == "upsert":
            return [M.upsert(table, batch, "customer_id", order=["seq"], strategy=strategy)]
        if fn == "update":
            return list(M.update(table, batch, "customer_id", strategy=strategy, order=["seq"]))
        if fn == "delete":
            return list(M.delete(table, batch, "customer_id", strategy=strategy))
        return [M.insert_ignore(table, batch, "customer_id", strategy=strategy, order=["seq"])]
    for a, b in zip(run("broadcast"), run("shuffle")):
        assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)
    assert sorted(map(tuple, run("auto")[0].collect()), key=repr) == \
        sorted(map(tuple, run("shuffle")[0].collect()), key=repr)


def test_repeated_keys_need_an_order(spark, table):
    batch = spark.createDataFrame([("4", 9.0, 1), ("4", 3.0, 2), ("1", 7.0, 1), ("1", 5.0, 2)],
                                  "customer_id string, charge double, seq int")
    for fn in (M.upsert, M.update, M.insert_ignore):
        with pytest.raises(M.RepeatedKeysError):
            fn(table, batch.drop("seq"), "customer_id")
    charge = lambda df: {r.customer_id: r.charge for r in df.collect()}
    assert charge(M.upsert(table, batch, "customer_id", order=["seq"])) == {"1": 5.0, "2": 20.0, "3": None, "4": 3.0}
    assert charge(M.update(table, batch, "customer_id", order=["seq"])[0])["1"] == 5.0
    ignored = M.insert_ignore(table, batch, "customer_id", order=["seq"])
    assert ignored.columns == table.columns and ignored.count() == 4 and charge(ignored)["4"] == 9.0
    # equal rows are no conflict
    assert M.insert_ignore(table, batch.filter("seq = 1").unionByName(batch.filter("seq = 1")).drop("seq"), "customer_id").count() == 4


def test_unique_batches_are_taken_as_they_are(spark, monkeypatch):
    table = spark.createDataFrame([("1", "LA"), ("2", "SF")], "customer_id string, city string")
    batch = spark.createDataFrame([("2", "SD"), ("3", "NY")], "customer_id string, city string")
    want = sorted(map(tuple, M.upsert(table, batch, "customer_id", order=["city"]).collect()))

    def refuse(*a, **k):
        raise AssertionError("the batch was evaluated")

    monkeypatch.setattr(M, "require_order", refuse)
    monkeypatch.setattr(M, "dedup_last", refuse)
    for strategy in ("broadcast", "shuffle"):
        got, _ = M.upsert_plan(table, batch, "customer_id", strategy=strategy, unique=True)
        assert sorted(map(tuple, got.collect())) == want == [("1", "LA"), ("2", "SD"), ("3", "NY")]
