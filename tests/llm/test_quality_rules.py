from churnspark.llm import quality_rules as Q
from tests.llm import brute

CASES = ["a b c d e f g h a b c d e f g h", "x " * 100, " ".join(map(str, range(30))), "### $$ " * 12, "SAME LINE\n" * 30,
         " ".join("abcdefgh" * 5) + " ", "\x0bone\x0ctwo\r\n", "w\u00a0x y\u2003z", "p q r s t u v w " * 2 + "tail " + "p q r s t u v w",
         "\n".join([" ".join(f"w{i}{j}" for j in range(9)) for i in range(6)] * 3), "ÄÖÜ " * 25]


def test_measurements(spark, edge):
    rows = [(k, t) for k, t in enumerate(CASES)] + [(None, None), (50, ""), (51, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").unionByName(edge.selectExpr("doc_id + 100 AS doc_id", "text"))
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    led = Q.apply_policy(Q.ledger(docs)).collect()
    key = lambda x: repr(x)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted([(r.doc_id, *[r[c] for c in names]) for r in led], key=key) == sorted(
        [(i, *[brute.quality(t)[c] for c in names]) for i, t in texts], key=key)
    for r in led:
        assert r.kept == (r.fail_bits == 0) and (not r.kept or not r.base_failed)


def test_policies_and_ablations(spark, edge, nothing):
    led = Q.ledger(edge).cache()
    rows = led.collect()
    for version in Q.POLICIES:
        kept = Q.apply_policy(led, version).filter("kept").count()
        assert kept == sum(r.fail_bits & Q.mask(version) == 0 for r in rows)
        for a in Q.ablations(led, version).collect():
            b = Q.bit(a.rule)
            assert a.failed == sum(r.fail_bits & b > 0 for r in rows)
            assert a.kept_without == sum(r.fail_bits & Q.mask(version) & ~b == 0 for r in rows)
    out = Q.keep(edge)
    assert out.columns == edge.columns and out.count() == sum(r.fail_bits == 0 for r in rows)
    assert Q.keep(nothing).count() == 0 and Q.ledger(nothing).count() == 0
