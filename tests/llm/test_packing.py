import itertools
import random

from tokenizers import Tokenizer

from churnspark.llm import bpe, packing


def padding(bounds, lengths, counts):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


def test_buckets_are_optimal():
    rnd = random.Random(4)
    for _ in range(40):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        counts = [rnd.choice([1, 1, 2, 50]) for _ in lengths]
        for k in range(1, 6):
            got = packing.best_buckets(lengths, counts, k)
            assert len(got) <= k and got[-1] == lengths[-1]
            best = min(padding([*c, lengths[-1]], lengths, counts)
                       for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            assert padding(got, lengths, counts) == best
    assert packing.best_buckets([], [], 3) == []


def test_batches(edge, nothing):
    rows = packing.pack(edge, n_buckets=3, token_budget=4096).collect()
    assert len(rows) == edge.count()
    assert len({(r.bucket, r.batch, r.slot) for r in rows}) == len(rows) and len({r.bucket for r in rows}) <= 3
    for r in rows:
        assert 0 <= r.padding == r.bucket - r.n_tokens and r.slot < max(1, 4096 // r.bucket)
    for b in {r.bucket for r in rows}:
        # batches are full but for the last
        slots = sorted((r.batch, r.slot) for r in rows if r.bucket == b)
        cap = max(1, 4096 // b)
        assert slots == [(k // cap, k % cap) for k in range(len(slots))]
    assert packing.pack(nothing).count() == 0


def test_lengths_are_encoded_tokens(spark, edge):
    lib = Tokenizer.from_file(bpe.tokenizer_path())
    n_tokens = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    sf = "/root/testdata/sf0.001"
    want = {r.doc_id: n_tokens(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = packing.query(spark, sf).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    # batches hold the budget in tokens
    held = {}
    for r in rows:
        held[r.bucket, r.batch] = held.get((r.bucket, r.batch), 0) + r.bucket
    assert all(n <= max(packing.TOKEN_BUDGET, b) for (b, _), n in held.items())
    by_row = sorted(((r.doc_id, n_tokens(r.text)) for r in edge.collect()), key=repr)
    got = packing.pack(edge, tokenizer=bpe.tokenizer_path()).collect()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=repr) == by_row
    solid = spark.createDataFrame([(1, "ab9" * 5000), (2, "a")], "doc_id long, text string")
    assert {r.doc_id: r.bucket for r in packing.pack(solid, tokenizer=bpe.tokenizer_path()).collect()}[1] > 1000
