import random

import numpy as np

from churnspark.llm import jaccard_join as J
from tests.llm import brute


def check(docs_rows, spark, rule=J.Rule()):
    docs = spark.createDataFrame(docs_rows, "doc_id long, text string")
    got = J.similar_documents(docs, rule=rule).collect()
    sets = [brute.shingle_set(t, rule.words) for _, t in docs_rows]
    comp = brute.components(sets, rule.percent)
    least = {}
    for (i, _), c in zip(docs_rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, len(s), least.get(c) if s else i) for (i, _), s, c in zip(docs_rows, sets, comp)), key=repr)
    assert sorted(((r.id, r.n, r.component_id) for r in got), key=repr) == want
    return want


def families(seed, n_families, size, words, edits):
    rnd = random.Random(seed)
    rows = []
    for f in range(n_families):
        base = [f"w{rnd.randrange(3000)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(rnd.randint(0, edits)):
                k = rnd.randrange(len(t))
                t[k] = f"x{rnd.randrange(40)}" if rnd.random() < .5 else f"y{rnd.random()}"
            if rnd.random() < .2:
                t = t[:len(t) - rnd.randrange(1, 1 + len(t) // 8)]
            rows.append((len(rows) * 7, " ".join(t)))
    rnd.shuffle(rows)
    return rows


def test_families_against_all_pairs(spark):
    rows = families(1, 6, 25, 120, 6) + [(10 ** 6 + i, t) for i, t in families(2, 25, 2, 9, 1)]
    want = check(rows, spark)
    sizes = [sum(w[2] == c for w in want) for c in {w[2] for w in want}]
    assert max(sizes) > 10 and min(sizes) == 1


def test_documents_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(rows, spark)


def test_other_rules_against_all_pairs(spark):
    rows = families(4, 6, 20, 110, 5) + [(10 ** 6 + i, t) for i, t in families(5, 25, 2, 9, 1)]
    for rule in (J.Rule(5, 80), J.Rule(1, 70), J.Rule(2, 100)):
        want = check(rows, spark, rule)
        assert 1 < len({w[2] for w in want}) < len(want)


def test_edge_rows(edge, nothing, spark):
    check([(r.doc_id, r.text) for r in edge.collect()], spark)
    kept = J.keep_one(edge)
    assert kept.columns == edge.columns
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    # of the copies the smallest id stays (null first); rows without words all stay
    assert len([t for i, t in texts if i in (4, 5)]) == 0 and sum(i is None for i, _ in texts) == 3
    assert {i for i, _ in texts} >= {1, 2, 3, 6, 7, 9, 10} and 8 not in {i for i, _ in texts}
    assert J.similar_documents(nothing).count() == 0 and J.keep_one(nothing).count() == 0


def test_one_row_of_repeated_rows_stays(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "c")], "doc_id long, text string, lang string")
    assert [tuple(r) for r in J.keep_one(docs).collect()] == [(1, text, "a")]


def test_sets_of_over_120_000_shingles(spark):
    words = [f"w{k}" for k in range(121_000)]
    near = [f"x{k}" if k % 9000 == 5 else w for k, w in enumerate(words)]
    want = check([(1, " ".join(words)), (2, " ".join(near)), (3, "w1 w2 w3")], spark)
    assert [c for _, _, c in want] == [1, 1, 3]


def test_divide_skip_counts_occurrences():
    rnd = random.Random(9)
    for _ in range(200):
        lists = [sorted(rnd.sample(range(30), rnd.randint(0, 30))) for _ in range(rnd.randint(1, 8))]
        need = rnd.randint(1, 8)
        count = {v: sum(v in x for x in lists) for v in range(30)}
        assert J.divide_skip(lists, need) == {v: c for v, c in count.items() if c >= need}
        a, b = (np.array(sorted(rnd.sample(range(50), rnd.randint(0, 30)))) for _ in range(2))
        assert J.probe(a, b) == len(set(a.tolist()) & set(b.tolist()))


def test_search_finds_what_leaders_leave(spark, monkeypatch):
    """Without leaders' links the search alone must give the same components."""
    monkeypatch.setattr(J, "leader_pairs", lambda lists, rule: lists.select(lists["rec"].alias("a"), lists["rec"].alias("b")).filter("a <> b"))
    check(families(3, 3, 14, 60, 4), spark)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {r.node: r.root for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: r for x, r in root.items() if x in touched}
