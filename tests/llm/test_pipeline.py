from tokenizers import Tokenizer

import corpus_pipeline
from churnspark.llm import bpe, packing, quality_rules, secrets
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_run_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    led = {r.doc_id: r.kept for r in quality_rules.query(spark, SF).collect()}
    docs = sorted(d for d in docs if led[d[0]])
    gone = brute.deleted_lines([(d[0], d[1]) for d in docs], 50)
    lines = lambda k, t: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]) if k in gone else t
    docs = [(i, lines(k, t), lang, s) for k, (i, t, lang, s) in enumerate(docs)]
    docs = [d for d in docs if brute.WORD.search(d[1])]
    comp = brute.components([brute.shingle_set(d[1], 5) for d in docs], 80)
    docs = [d for k, d in enumerate(docs) if comp[k] == k]
    owners = {}
    for i, t, lang, s in docs:
        for x in secrets.candidates(t):
            owners.setdefault(x[3], set()).add(s)
    encoder = Tokenizer.from_file(bpe.tokenizer_path())
    want = {}
    for i, t, lang, s in docs:
        hidden = [False] * len(t)
        for a, _, e, v in secrets.candidates(t):
            if len(owners[v]) < secrets.EXAMPLE_OWNERS:
                hidden[a:e] = [True] * (e - a)
        # spans that touch become one mark
        t = "".join("[SECRET]" if h and (k == 0 or not hidden[k - 1]) else "" if h else c for k, (c, h) in enumerate(zip(t, hidden)))
        want[i] = len(encoder.encode(t, add_special_tokens=False).ids)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    assert {r.bucket for r in rows} and len({r.bucket for r in rows}) <= packing.N_BUCKETS


def test_stages_on_edge_rows_and_no_rows(spark, edge, nothing):
    for docs in (edge, nothing):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, None)
            assert out.columns == docs.columns, name
            assert out.count() <= n
        assert corpus_pipeline.STAGES[-1][1](spark, docs, None).count() == n
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near duplicates", "secret scan", "packing"]
