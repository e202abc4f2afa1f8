import hashlib
import math
import random
import re
from zlib import crc32

from pyspark.sql import functions as F

from churnspark.llm import resampling

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def feats(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target):
    s, t = [0] * 10000, [0] * 10000
    for held, texts in ((s, [d[1] for d in docs]), (t, target)):
        for x in texts:
            for b in feats(x)[1]:
                held[b] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for i, x in docs:
        n, f = feats(x)
        weight = math.floor(sum(gain[b] for b in f) / len(f)) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:25 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = brute(docs, target)
    assert sum(r[4] is not None for r in want) > 20
    assert rows_of(resampling.query(spark, SF)) == want


def test_features_by_pieces():
    rnd = random.Random(2)
    text = "".join(rnd.choice("aB9 é中-\n ZZ_") for _ in range(5000))
    n, want = feats(text)
    for size in (1, 7, 100, 1 << 20):
        got = list(resampling.features(text.encode(), 10000, size))
        assert sum(x[0] for x in got) == n and sorted(b for x in got for b in x[1].tolist()) == sorted(want)
    assert list(resampling.features(b"", 10000)) == [] and list(resampling.features(b" -- ", 10000)) == []


def test_selection_finds_every_place(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 2, 2, 2, 3, 50, -4]), rnd.choice([None, 1, 2, 3, 4]), rnd.randrange(3)) for _ in range(120)]
    df = spark.createDataFrame(rows, "score long, doc_id long, th long").repartition(4).cache()
    key = resampling._key(["score", "doc_id", "th"])
    order = sorted((-s, i is None, i or 0, t) for s, i, t in rows)
    for k in (1, 2, 30, 60, 61, 119, 120):
        got = resampling.kth_key(df, key, k, pivots=3)
        assert (got[0], got[1], got[2] or 0, got[4]) == order[k - 1]
    assert resampling.kth_key(df, key, 0) is None and resampling.kth_key(df, key, 121) is None


def test_equal_rows_share_the_room(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.createDataFrame([(5, text)] * 40 + [(6, None)], "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("w1 w2",)], "text string")
    out = resampling.resample(docs, target)
    assert sorted(r["rank"] for r in out.collect() if r["rank"]) == list(range(1, 11)) and out.count() == 41


def test_edge_rows(spark, edge, nothing):
    bench = spark.createDataFrame([("w1 w2 w3",), (None,)], "text string")
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    want = brute(docs, ["w1 w2 w3", None])
    got = rows_of(resampling.resample(edge, bench))
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert sorted(r[4] for r in got if r[4]) == list(range(1, 1 + sum(r[4] is not None for r in want)))
    assert resampling.resample(nothing, bench).count() == 0
    empty = rows_of(resampling.resample(edge, bench.filter(F.lit(False))))
    assert len(empty) == len(docs)
