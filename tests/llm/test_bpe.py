import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from churnspark.llm import bpe, token_counts

PATH = bpe.tokenizer_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_merge(vocab, symbols):
    s = list(symbols)
    while True:
        ranks = [(vocab.rank_of.get(a * vocab.base + b), i) for i, (a, b) in enumerate(zip(s, s[1:]))]
        ranks = [x for x in ranks if x[0] is not None]
        if not ranks:
            return s
        r, i = min(ranks)
        s[i:i + 2] = [int(vocab.made[r])]


def texts():
    rnd = random.Random(2)
    out = ["", " ", "Hello world's 123", "<|startoftext|>x<|endoftext|><|endoftext|>", "ΑΣ ΣΑΣ İ ŀ", "a\x1cb\x85c\u200bd\u3000e",
           "don't we'LL", "a" * 3000, "中文字符 \U0001f600!!", "e\u0301 é ﬁ ½ ²", "\u0558\ua7ceA", "__x--", "x" + "ab" * 400 + " y"]
    out += ["".join(rnd.choice("abcdehinrstu éüñ,.'1\n") for _ in range(rnd.randint(1, 300))) for _ in range(80)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 1400), rnd.randrange(0x2000, 0x3100)])) for _ in range(60)) for _ in range(40)]
    return out


def test_trees_merge_as_the_definition_says():
    vocab = bpe.vocabulary(bpe.read_tokenizer(PATH))
    rnd = random.Random(1)
    words = ["".join(rnd.choice("etaoinshr") for _ in range(n)) for n in [1, 2, 3, 4, 5, 7, 8, 9, 16, 17, 31, 64] * 6]
    symbols = [vocab.symbols(w) for w in words]
    want = [plain_merge(vocab, s.tolist()) for s in symbols]
    assert [x.tolist() for x in bpe.merge_many(vocab, symbols)] == want
    for s, w in zip(symbols, want):
        if len(s) > 1:
            assert bpe.merge_long(vocab, s).tolist() == w


def test_equals_the_library(spark, library):
    rows = list(enumerate(texts())) + [(9999, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    full = {r.doc_id: r for r in bpe.encode_texts(docs, PATH).collect()}
    short = {r.doc_id: r for r in bpe.encode_digests(docs, PATH).collect()}
    vocab = bpe.vocabulary(bpe.read_tokenizer(PATH))
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert list(full[i].ids) == ids and full[i].decoded == text, repr(t)
        raw = np.array(ids, dtype="<u4").tobytes()
        assert bpe.decode(vocab, raw) == text
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_ascii_words_and_lengths(spark, library):
    vocab = bpe.vocabulary(bpe.read_tokenizer(PATH))
    rnd = random.Random(6)
    assert vocab.ascii_word is not None
    plain = ["".join(chr(rnd.randrange(128)) for _ in range(200)) for _ in range(200)] + ["i'll don't we're o'd x's'sa 12a3"]
    for t in plain:
        assert vocab.ascii_word.findall(t.lower()) == vocab.word.findall(t.lower()), repr(t)
    known = bpe.Lengths(vocab)
    every = plain + texts()
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in every]
    assert known.count(every) == want and known.count(every[::-1]) == want[::-1]
    assert not any(len(w) > bpe.WIDE for w in known.known)


def test_edge_rows(edge, nothing):
    assert bpe.encode_digests(edge, PATH).count() == edge.count()
    assert bpe.encode_digests(nothing, PATH).count() == 0 and bpe.encode_texts(nothing, PATH).count() == 0


def test_length_histogram(spark, edge, nothing, library):
    lengths = sorted(len(library.encode(r.text or "", add_special_tokens=False).ids) for r in edge.select("text").collect())
    sums = token_counts.suffix_sums(token_counts.histogram(bpe.encoded_lengths(edge, PATH))).cache()
    for r in sums.collect():
        at = r.n_tokens
        assert r.n_docs == lengths.count(at) and r.docs_ge == sum(x >= at for x in lengths)
        assert r.tokens_ge == sum(x for x in lengths if x >= at) and r.total_tokens == sum(lengths)
        assert r.truncated_total == sum(min(x, at) for x in lengths)
        assert r.share_le == sum(x <= at for x in lengths) / len(lengths)
    for r in token_counts.at_limits(sums, [0, 1, 100, 5000, 10 ** 9]).collect():
        assert r.truncated_total == sum(min(x, r.context_limit) for x in lengths)
    for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == next(x for k, x in enumerate(lengths) if (k + 1) / len(lengths) >= r.prob)
    assert token_counts.suffix_sums(token_counts.histogram(bpe.encoded_lengths(nothing, PATH))).count() == 0
