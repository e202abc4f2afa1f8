import random

import pytest

from pyspark.sql import functions as F

from churnspark.llm import line_dedup
from tests.llm import brute


def kept_text(text, gone):
    return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)


@pytest.mark.parametrize("hot", [line_dedup.HOT, 30, 1])
def test_equals_every_run_tried(spark, monkeypatch, hot):
    # all intervals hot, some of them, none of them
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rnd = random.Random(3)
    lines = [" ".join(["ab"] * rnd.randint(1, 4)) + f" {k}" for k in range(25)]
    rows = []
    for i in range(60):
        text = [rnd.choice(lines) if rnd.random() < .6 else f"unique {i} {rnd.random()}" for _ in range(rnd.randint(0, 14))]
        if rnd.random() < .3 and rows:
            other = rows[rnd.randrange(len(rows))][1].split("\n")
            a = rnd.randrange(len(other))
            text[1:1] = other[a:a + rnd.randint(2, 9)]
        if rnd.random() < .3:
            text.insert(rnd.randint(0, len(text)), " ")
        rows.append((i * 3, "\n".join(text)))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_words=9).collect()}
    gone = brute.deleted_lines([(i, t) for i, t in rows], 9)
    assert sum(map(len, gone.values())) > 20
    for k, (i, t) in enumerate(rows):
        assert got[i] == kept_text(t, gone.get(k, set())), i


def test_overlapping_copies_and_a_long_document(spark):
    line = "five words on this line"
    rows = [(1, "\n".join([line] * 200)), (2, "\n".join([line] * 3)), (3, "head\n" + "\n".join([line] * 12))]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    gone = brute.deleted_lines(rows, 50)
    assert [got[i] for i, _ in rows] == [kept_text(t, gone.get(k, set())) for k, (_, t) in enumerate(rows)]
    # the first run of ten lines stays, what repeats it goes
    assert got[1].count(line) < 20 and got[2] == rows[1][1] and got[3] == "head"


def test_hot_interval_is_not_shuffled(spark):
    runs = spark.range(3000).select(
        F.col("id"), F.lit(1).cast("long").alias("th"), F.lit(0).alias("seg"), F.lit(0).alias("seq"), F.lit(3).alias("n"),
        F.when(F.col("id") < 1000, 0).otherwise(1 + F.col("id") % 1000).cast("long").alias("ra"), F.lit(7).cast("long").alias("rb"))
    out = line_dedup.later(runs)
    found = {r.id for r in out.collect()}
    first = {}
    for i in range(3000):
        first.setdefault(0 if i < 1000 else 1 + i % 1000, i)
    assert found == set(range(3000)) - set(first.values())
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()


def test_edge_rows(edge, nothing):
    out = line_dedup.dedup(edge)
    assert out.columns == edge.columns
    rows = out.collect()
    assert len(rows) == edge.count()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text)
    # the null id comes first, so its copy stays and the repeated rows of id 4 lose theirs
    assert sorted(len(t or "") for t in texts[None]) == sorted([0, 0, max(len(t or "") for t in texts[None])])
    assert texts[4] == ["", ""] and texts[11] == ["end of it"] and len(texts[10][0]) > 50_000
    assert texts[1] == [None] and texts[2] == [""] and texts[3] == [" \n\t\n"]
    assert line_dedup.dedup(nothing).count() == 0
