import hashlib
import random
import re

import xxhash
from pyspark.sql import functions as F

from churnspark.llm import fingerprints as P


def words(n, tag=""):
    return " ".join(f"{tag}{(k * 7919) % 1009}" for k in range(n))


def test_edits_and_likeness(spark):
    rows = [(5, words(300)), (4, words(300, "b")), (3, words(300)), (2, "tiny"), (1, None), (0, "é" * 7 + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, e, x = F.col("anchors"), F.col("edited_anchors"), F.col("next_anchors")
    got = {r.id: r for r in P.with_edited(docs).select(
        "*", P.likeness(a, e).alias("ne"), P.likeness(a, x).alias("nn"), P.as_string(a).alias("fp"), P.aligned(a, e).alias("al")).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        assert got[i].edited_sha256 == hashlib.sha256((t[:len(t) - m] + nxt[:m]).encode()).hexdigest()
        assert got[i].n_chars == len(t)
    assert got[5].fp == got[3].fp != got[4].fp and got[1].fp == ""
    assert .2 < got[5].ne < .9 and got[5].nn == 0 and got[5].al > 0
    assert got[1].ne == 1 and got[2].nn == 0


def test_anchors_are_closed_syncmers(spark):
    docs = spark.createDataFrame([(1, words(40)), (2, "lead " + words(40))], "doc_id long, text string")
    shift = P.fingerprints(docs).collect()
    by = {r.id: {x.h: x.p for x in r.anchors} for r in shift}
    both = by[1].keys() & by[2].keys()
    # anchors are free of context: a word in front moves them and changes only those over the edge
    assert len(both) >= len(by[1]) - P.K and all(by[2][h] - by[1][h] == 1 for h in both)
    assert all(x.p <= 40 - P.K for r in shift if r.id == 1 for x in r.anchors)


def test_edge_rows(edge, nothing, spark):
    out = P.with_edited(edge)
    assert out.count() == edge.count() and P.with_edited(nothing).count() == 0
    rows = [r for r in out.collect() if r.id == 4]
    assert len(rows) == 2 and rows[0] == rows[1]
    one = spark.createDataFrame([(1, "abc def")], "doc_id long, text string")
    assert P.with_edited(one).first().edited_sha256 == hashlib.sha256(b"abc dab").hexdigest()


def test_every_anchor_is_kept(spark):
    """Long texts keep anchors all along, repeated ones at each place; likeness and aligned are exact."""
    t = [f"w{k}" for k in range(900)]
    lines = " ".join([*t[:300], *t[:300]])
    rows = [(1, " ".join(t)), (2, " ".join([*t[:20], *(f"x{k}" for k in range(880))])), (3, lines)]
    got = {r.id: [(x.h, x.p) for x in r.anchors] for r in
           P.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    places = sorted(p for _, p in got[1])
    assert len(places) > 500 and max(b - a for a, b in zip(places, places[1:])) < 20 and places[-1] > 880
    twice = {h for h, p in got[3] if p < 297} & {h for h, p in got[3] if p >= 300}
    assert len(twice) > 150 and len(got[3]) > len({h for h, _ in got[3]})
    pair = spark.createDataFrame([(got[1], got[2])], "a array<struct<h:bigint,p:int>>, b array<struct<h:bigint,p:int>>")
    row = pair.select(P.likeness(F.col("a"), F.col("b")), P.aligned(F.col("a"), F.col("b")), P.as_string(F.col("a"))).first()
    one, two = ({h for h, _ in got[k]} for k in (1, 2))
    assert 0 < row[0] == len(one & two) / len(one | two) < .02
    assert row[1] == len(set(got[1]) & set(got[2])) > 5
    assert row[2] == ",".join(f"{h % 2 ** 64:016x}:{p}" for h, p in got[1])


def brute_anchors(text):
    """Closed syncmers by their definition, over every k-mer of the letters."""
    def chain(parts):
        seed = 42
        for x in parts:
            seed = xxhash.xxh64(x if isinstance(x, bytes) else x.to_bytes(8, "little"), seed=seed).intdigest()
        return seed
    letters = []
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        cuts = [word.encode()] if len(word) <= P.SHORT else [
            word[i:i + P.WINDOW].encode("utf-32-be") for i in range(len(word) - P.WINDOW + 1)]
        letters += [chain([c]) for c in cuts]
    signed = lambda v: v - 2 ** 64 if v >= 2 ** 63 else v
    if 0 < len(letters) < P.K:
        return [(signed(chain(letters)), 0)]
    out = []
    for i in range(len(letters) - P.K + 1):
        inner = [signed(chain(letters[j:j + P.S])) for j in range(i, i + P.K - P.S + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append((signed(chain(letters[i:i + P.K])), i))
    return sorted(out)


def test_anchors_equal_brute_force(edge, spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice("abé中文 \n\U0001f600") for _ in range(rnd.randrange(400))) for _ in range(40)]
    made += ["".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(n)) for n in (1, 8, 15, 16, 17, 18, 900)]
    made += ["x" * 40, "a" * 16 + " " + "b" * 17, "see https://example.org/a/long/path?with=query now", "a b", " "]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for frame in (docs, edge):
        texts = [r.text for r in frame.select("doc_id", "text").collect()]
        got = [[(x.h, x.p) for x in r.anchors] for r in P.fingerprints(frame).collect()]
        assert sorted(got) == sorted(brute_anchors(t) for t in texts)


def test_text_without_spaces(spark):
    rnd = random.Random(4)
    text = lambda: "".join(chr(0x4E00 + rnd.randrange(3000)) for _ in range(9000))
    docs = spark.createDataFrame([(2, text()), (1, text())], "doc_id long, text string")
    a, e, x = F.col("anchors"), F.col("edited_anchors"), F.col("next_anchors")
    for r in P.with_edited(docs).select("anchors", P.likeness(a, e).alias("ne"), P.likeness(a, x).alias("nn")).collect():
        places = sorted(y.p for y in r.anchors)
        assert len(places) > 5000 and max(q - p for p, q in zip(places, places[1:])) < 20 and places[-1] > 8900
        assert .4 < r.ne < .6 and r.nn == 0


def test_only_closed_kmers_are_hashed(spark, monkeypatch):
    """Places are chosen before k-mers are hashed; the choice holds for other k and s too."""
    docs = spark.createDataFrame([(1, words(60)), (2, "a b a b a b a b a"), (3, "x " * 30), (4, "a b c")], "doc_id long, text string")
    plan = P.fingerprints(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(sequence(" in plan
    texts = [r.text for r in docs.select("text").collect()]
    for k, s in ((3, 1), (5, 1), (6, 2), (4, 3)):
        monkeypatch.setattr(P, "K", k)
        monkeypatch.setattr(P, "S", s)
        got = [[(x.h, x.p) for x in r.anchors] for r in P.fingerprints(docs).collect()]
        assert sorted(got) == sorted(brute_anchors(t) for t in texts)
