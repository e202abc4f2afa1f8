"""Readers and sinks: upload CSV quirks (T20), envelopes, export, versioned tables."""

import json
import os

import pytest
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.operators import clean as C
from churnspark.operators import merge as M
from churnspark.sources import claims
from churnspark.sources import readers as RD
from churnspark.sources import tables as TB

UPLOAD_HEADER = S.upload_csv_columns()


def _upload_line(cid, city, lat_long, category=""):
    vals = {c: "" for c in UPLOAD_HEADER}
    vals.update({"customer_id": cid, "country": "United States", "city": city, "lat_long": lat_long,
                 "gender": "Female", "age": "41", "internet_type": "None", "monthly_charge": "70.5",
                 "churn_value": "0", "churn_category": category})
    out = []
    for c in UPLOAD_HEADER:
        v = vals[c]
        out.append('"' + v.replace('"', '""') + '"' if ("," in v or '"' in v) else v)
    return ",".join(out)


def test_upload_csv_quotes_bom_crlf(spark, tmp):
    p = os.path.join(tmp, "upload.csv")
    lines = [",".join(UPLOAD_HEADER), _upload_line("0001-ABCDE", "Fresno", '"36.7, -119.7"'),
             _upload_line("", "Nowhere", '"1.0, 2.0"'), _upload_line("0002-XYZAB", "Los Angeles", '"34.0, -118.2"', "Price")]
    with open(p, "w", encoding="utf-8-sig", newline="") as f:
        f.write("\r\n".join(lines) + "\r\n")
    df = RD.read_upload_csv(spark, p)
    assert df.columns == UPLOAD_HEADER
    rows = df.orderBy("city").collect()
    assert len(rows) == 3
    assert rows[0]["lat_long"] == '"36.7, -119.7"'                        # doubled quotes kept in one field
    assert rows[0]["internet_type"] == "None"
    good, bad = C.split_rejects(C.blanks_to_null(df))
    assert good.count() == 2 and bad.count() == 1
    hdr = os.path.join(tmp, "nokey.csv")
    with open(hdr, "w") as f:
        f.write("city,state\nA,B\n")
    with pytest.raises(C.MissingColumnsError):
        RD.read_upload_csv(spark, hdr)


def test_topic_reader_renames_and_types(spark, tmp):
    p = os.path.join(tmp, "demographics.csv")
    with open(p, "w") as f:
        f.write("Customer ID,Gender,Age,Under 30,Senior Citizen,Married,Dependents,Number of Dependents,Extra\n")
        f.write("0001-A,Male,71,No,Yes,Yes,No,0,zz\n")
    df = RD.read_topic(spark, "demographics", p)
    assert df.columns == list(S.DEMOGRAPHICS_MAP.values())
    r = df.first()
    assert r["partner"] == "Yes" and r["age"] == 71 and r["number_of_dependents"] == 0
    loc = os.path.join(tmp, "location.csv")
    with open(loc, "w") as f:
        f.write('Customer ID,Country,State,City,Zip Code,Lat Long,Latitude,Longitude\n')
        f.write('0001-A,United States,California,Fresno,93650,"36.8, -119.8",36.8,-119.8\n')
    lr = RD.read_topic(spark, "location", loc).first()
    assert lr["zip_code"] == "93650" and float(lr["latitude"]) == 36.8


def test_scoring_file_dispatch(spark, tmp):
    with pytest.raises(ValueError):
        RD.read_scoring_file(spark, os.path.join(tmp, "x.xlsx"))


def test_json_envelope_and_bare_list(spark, tmp):
    env = os.path.join(tmp, "env.json")
    with open(env, "w") as f:
        json.dump({"count": 2, "customers": [{"customer_id": "a", "age": 30}, {"customer_id": "b"}]}, f)
    assert RD.read_json_records(spark, env).count() == 2
    bare = os.path.join(tmp, "bare.json")
    with open(bare, "w") as f:
        json.dump([{"customer_id": "c", "city": "X"}], f)
    assert RD.read_json_records(spark, bare).first()["city"] == "X"
    lines = os.path.join(tmp, "lines.json")
    with open(lines, "w") as f:
        f.write('{"customer_id": "d", "age": 5}\n{"customer_id": "e"}\n')
    assert [r["customer_id"] for r in RD.read_json_records(spark, lines, lines=True).orderBy("customer_id").collect()] == ["d", "e"]
    open(os.path.join(tmp, "none.json"), "w").close()
    with pytest.raises(ValueError):
        RD.read_json_records(spark, os.path.join(tmp, "none.json"), lines=True)
    empty = os.path.join(tmp, "empty.json")
    with open(empty, "w") as f:
        json.dump({"count": 0, "customers": []}, f)
    with pytest.raises(ValueError):
        RD.read_json_records(spark, empty)


def test_page_offset_without_limit(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    assert [r[0] for r in RD.page(df, "k", limit=3, offset=4).collect()] == [4, 5, 6]
    assert RD.page(df, "k", offset=4).count() == 10                       # offset ignored without limit


def test_export_csv(spark, tmp):
    df = spark.createDataFrame([("a", None, 'say "hi"', [1])], "id string, p double, t string, arr array<int>")
    out = os.path.join(tmp, "export")
    TB.export_csv(df, out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.endswith(".csv"))
    assert text.splitlines()[0] == '"id","p","t"'
    assert '"a",,"say ""hi"""' in text or '"a","","say ""hi"""' in text


def test_versioned_table(spark, tmp):
    t = TB.VersionedTable(spark, os.path.join(tmp, "customers"), key="customer_id")
    with pytest.raises(TB.VersionNotFound):
        t.read()
    assert t.read_or_warn(3) is None
    v1 = spark.createDataFrame([("1", "LA"), ("2", "SF")], "customer_id string, city string")
    assert t.snapshot_if_changed(v1) == 1
    assert t.snapshot_if_changed(v1.orderBy(F.desc("customer_id"))) is None     # same rows, other order
    assert t.upsert(spark.createDataFrame([("2", "Oakland"), ("3", "SD")], "customer_id string, city string")) == 2
    added, removed = t.diff(1, 2)
    assert sorted(tuple(r) for r in added.collect()) == [("2", "Oakland"), ("3", "SD")]
    assert [tuple(r) for r in removed.collect()] == [("2", "SF")]
    assert [tuple(r) for r in t.counts().collect()] == [(2, 3, 2)]
    assert t.read(1).count() == 2 and t.cached().count() == 3


def test_small_upsert_leaves_the_table_where_it_stands(spark, tmp, monkeypatch):
    t = TB.VersionedTable(spark, os.path.join(tmp, "standing"), key="customer_id", files_per_version=4)
    rows = spark.range(1000).select(F.format_string("%05d", "id").alias("customer_id"), F.lit("LA").alias("city"))
    t.publish(rows)
    batch = spark.createDataFrame([("00007", "SF"), ("99999", "SD")], rows.schema)

    def refuse(*args, **kwargs):
        raise AssertionError("the table was range-partitioned")

    with monkeypatch.context() as m:
        m.setattr(type(rows), "repartitionByRange", refuse)
        assert t.upsert(batch) == 2
    got = t.read()
    assert got.count() == 1001 and got.select("customer_id").distinct().count() == 1001
    assert {r.customer_id: r.city for r in got.filter("city <> 'LA'").collect()} == {"00007": "SF", "99999": "SD"}
    # key ranges of the old files are still apart
    spans = got.filter("customer_id < '99999'").groupBy(F.input_file_name().alias("f")).agg(
        F.min("customer_id").alias("lo"), F.max("customer_id").alias("hi")).orderBy("lo").collect()
    assert all(a.hi < b.lo for a, b in zip(spans, spans[1:]))
    merged, strategy = M.upsert_plan(t.read(), batch, "customer_id", max_broadcast_bytes=0)
    assert strategy == "shuffle" and merged.count() == 1001


def test_table_cache_ttl(spark, tmp):
    t = TB.VersionedTable(spark, os.path.join(tmp, "cached"), key="customer_id")
    t.publish(spark.createDataFrame([("1", "LA")], "customer_id string, city string"))
    now = [0.0]
    cache = TB.TableCache(t, ttl_seconds=60, clock=lambda: now[0])
    first = cache.get()
    assert cache.version == 1 and first.count() == 1
    t.publish(spark.createDataFrame([("1", "LA"), ("2", "SF")], "customer_id string, city string"))
    now[0] = 30.0
    assert cache.get() is first and cache.version == 1          # within the TTL: stale view kept
    now[0] = 61.0
    assert cache.get().count() == 2 and cache.version == 2      # expired and a newer version exists
    again = cache.get()
    now[0] = 200.0
    assert cache.get() is again                                 # expired, same version: no re-read


def test_file_order_across_splits(spark, tmp):
    p = os.path.join(tmp, "big.csv")
    with open(p, "w") as f:
        f.write("customer_id,seq\n")
        for i in range(3000):
            f.write(f"C{i:05d}{'x' * (i % 7)},{i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")              # many splits of one file
    try:
        df = RD.with_file_order(RD.read_upload_csv(spark, p), "_ord")
        assert df.rdd.getNumPartitions() > 5
        got = [int(r.seq) for r in df.orderBy("_ord").select("seq").collect()]
        numbered = RD.file_row_numbers(RD.read_upload_csv(spark, p), "rn")
        pairs = sorted((int(r.rn), int(r.seq)) for r in numbered.select("rn", "seq").collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(3000))
    assert pairs == [(i + 1, i) for i in range(3000)]                       # numbering without a shuffle


def test_file_row_numbers_on_a_shuffled_frame(spark):
    df = spark.range(500).repartition(7)                  # not a file scan: still a valid 1..n numbering
    got = sorted(r.rn for r in RD.file_row_numbers(df, "rn").select("rn").collect())
    assert got == list(range(1, 501))


def _log_rows(spark, *ids):
    return spark.createDataFrame([(i, 0.5, True) for i in ids], "customer_id string, churn_probability double, predicted_churn boolean")


def test_log_keeps_rows_of_every_writer(spark, tmp):
    log = os.path.join(tmp, "shared_log")
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    assert TB.append_logs(spark, log, _log_rows(spark, "a", "b", "c")) == 3
    TB.append_logs(spark, log, _log_rows(spark, "d"), batch_id=0, source="first")
    TB.append_logs(spark, log, _log_rows(spark, "e"), batch_id=0, source="second")
    TB.append_logs(spark, log, _log_rows(spark, "f"))
    TB.append_logs(spark, log, _log_rows(spark, "d"), batch_id=0, source="first")          # replayed
    rows = sorted((r.customer_id, r.inference_id) for r in spark.read.parquet(log).collect())
    assert rows == [("a", 1), ("b", 2), ("c", 3), ("d", 4), ("e", 5), ("f", 6)]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == before


def test_unreadable_catalog_raises_and_versions_are_never_overwritten(spark, tmp, monkeypatch):
    t = TB.VersionedTable(spark, os.path.join(tmp, "guarded"), key="customer_id")
    three = spark.createDataFrame([("1", "LA"), ("2", "SF"), ("3", "SD")], "customer_id string, city string")
    assert t.publish(three) == 1
    one = spark.createDataFrame([("9", "NY")], "customer_id string, city string")

    def unreadable(*a, **k):
        raise PermissionError("catalog cannot be listed")

    with monkeypatch.context() as m:
        m.setattr(claims, "read_if_there", unreadable)
        with pytest.raises(PermissionError):
            t.upsert(one)
    assert t.read().count() == 3
    # two writers that both started from version 1
    with monkeypatch.context() as m:
        m.setattr(TB.VersionedTable, "latest_version", lambda self: 1)
        assert t.publish(three.limit(2)) == 2
        with pytest.raises(TB.VersionConflict):
            t.publish(one)
    assert t.latest_version() == 2 and t.read(2).count() == 2


def test_csv_rows_are_never_shifted(spark, tmp):
    p = os.path.join(tmp, "newline.csv")
    with open(p, "w") as f:
        f.write('customer_id,churn_reason,age\n1,"two\nlines",30\n2,plain,40\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        RD.read_upload_csv(spark, p).collect()
    rows = RD.read_upload_csv(spark, p, multiline=True).orderBy("customer_id").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines", "30"), ("2", "plain", "40")]
    folder = os.path.join(tmp, "orders")
    os.makedirs(folder)
    for name, text in (("a.csv", "customer_id,age,cltv\n1,30,2000\n"), ("b.csv", "customer_id,cltv,age\n2,2000,40\n")):
        with open(os.path.join(folder, name), "w") as f:
            f.write(text)
    got = RD.read_upload_csv(spark, folder).orderBy("customer_id").collect()
    assert [r.asDict() for r in got] == [{"customer_id": "1", "age": "30", "cltv": "2000"}, {"customer_id": "2", "age": "40", "cltv": "2000"}]
    # columns that a file lacks are NULL there; the key must be in every file
    with open(os.path.join(folder, "c.csv"), "w") as f:
        f.write("city,customer_id\nLA,3\n")
    got = RD.with_file_order(RD.read_upload_csv(spark, folder), "_ord").orderBy("_ord").drop("_ord").collect()
    assert [(r.customer_id, r.age, r.city) for r in got] == [("1", "30", None), ("2", "40", None), ("3", None, "LA")]
    with open(os.path.join(folder, "d.csv"), "w") as f:
        f.write("city\nLA\n")
    with pytest.raises(C.MissingColumnsError):
        RD.read_upload_csv(spark, folder)


def test_overlong_values_fail_the_upload(spark):
    from churnspark.streaming import jobs as SJ
    long = spark.createDataFrame([("1", "x" * 500)], "customer_id string, gender string")
    with pytest.raises(SJ.BatchTypeError, match="longer"):
        SJ.typed_upload(long)


def test_a_lost_writer_blocks_nobody(spark, tmp, monkeypatch):
    t = TB.VersionedTable(spark, os.path.join(tmp, "lost"), key="customer_id", settle_seconds=0)
    rows = lambda *x: spark.createDataFrame(list(x), "customer_id string, city string")
    assert t.publish(rows(("1", "LA"))) == 1

    def dies(*a, **k):
        raise RuntimeError("driver lost")

    # between the data and the catalog
    with monkeypatch.context() as m:
        m.setattr(TB.VersionedTable, "_record", dies)
        with pytest.raises(RuntimeError):
            t.publish(rows(("1", "SF")))
    assert t.latest_version() == 1 and t.read().first()["city"] == "LA"
    assert t.publish(rows(("1", "SD"))) == 2 and t.read().first()["city"] == "SD"
    # while the catalog entry was written: a folder without a row
    os.makedirs(os.path.join(tmp, "lost", "_catalog", "n=3", "try=0"))
    assert t.latest_version() == 2
    assert t.publish(rows(("1", "NY"))) == 4 and t.read().first()["city"] == "NY"
    # the writer of version 3 was only slow: it finds its number void
    with pytest.raises(claims.Taken):
        os.rmdir(os.path.join(tmp, "lost", "_catalog", "n=3", "try=0"))
        claims.claim(spark, t._catalog_path, 3, ("x", None, 1, ""), TB.ENTRY_SCHEMA)
    assert [r.version for r in t.versions().orderBy("version").collect()] == [1, 2, 4]
    assert t.publish(rows(("1", "LV"))) == 5


def test_log_ids_never_repeat(spark, tmp, monkeypatch):
    log = os.path.join(tmp, "ids")
    TB.append_logs(spark, log, _log_rows(spark, "a", "b"), batch_id=0, source="s")

    def dies(*a, **k):
        raise RuntimeError("driver lost")

    # lost after the ids were reserved, before the rows were written
    with monkeypatch.context() as m:
        m.setattr(TB.F, "current_timestamp", dies)
        with pytest.raises(RuntimeError):
            TB.append_logs(spark, log, _log_rows(spark, "c"), batch_id=1, source="s")
    TB.append_logs(spark, log, _log_rows(spark, "d"), batch_id=0, source="other")
    TB.append_logs(spark, log, _log_rows(spark, "c"), batch_id=1, source="s")                # replayed
    ids = lambda: sorted((r.customer_id, r.inference_id) for r in spark.read.parquet(log).collect())
    assert ids() == [("a", 1), ("b", 2), ("c", 3), ("d", 4)]
    # two writers that read the same ranges: the second one takes the next
    stale = [TB.claims(spark, f"{log}/_ids", TB.RANGE_SCHEMA).filter("n <= 3")]
    real = TB.claims
    with monkeypatch.context() as m:
        m.setattr(TB, "claims", lambda *a: stale.pop() if stale else real(*a))
        TB.append_logs(spark, log, _log_rows(spark, "e"))
        stale.append(real(spark, f"{log}/_ids", TB.RANGE_SCHEMA).filter("n <= 3"))
        TB.append_logs(spark, log, _log_rows(spark, "f"))
    assert ids()[4:] == [("e", 5), ("f", 6)]
    # a log without ranges goes on after its greatest id
    old = os.path.join(tmp, "old")
    spark.read.parquet(log).write.partitionBy("source", "batch_id").parquet(old)
    TB.append_logs(spark, old, _log_rows(spark, "g"))
    assert max(r.inference_id for r in spark.read.parquet(old).collect()) == 7


def test_first_upsert_needs_an_order_for_repeated_keys(spark, tmp):
    t = TB.VersionedTable(spark, os.path.join(tmp, "first"), key="customer_id")
    twice = spark.createDataFrame([("1", "9", 1), ("1", "3", 2)], "customer_id string, city string, seq int")
    with pytest.raises(M.RepeatedKeysError):
        t.upsert(twice.drop("seq"))
    assert t.latest_version() is None
    assert t.upsert(twice, order=["seq"]) == 1 and t.read().first()["city"] == "3"


def test_metadata_round_trip(spark, tmp):
    meta = {"model_version": "v1", "trained_at": "now", "n_train_rows": 8, "n_test_rows": 2, "features": ["a"],
            "metrics": {"f1": 0.5}, "top_feature_importances": {"a": 1.0}, "class_balance_pct": {"0": 60.0}, "null_targets": 7}
    p = os.path.join(tmp, "meta")
    assert TB.read_metadata(spark, p) is None
    TB.write_metadata(spark, meta, p)
    assert TB.read_metadata(spark, p) == meta
