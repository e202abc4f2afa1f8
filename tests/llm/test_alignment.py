import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from churnspark.llm import alignment
from churnspark.llm.bpe import byte_alphabet
from tests.llm.conftest import edge_rows

A, B = alignment.paths()


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def tokens(libraries, text):
    """(A, B) as lists of (id, bytes), None where the contract says there are none."""
    a, b = libraries
    if not text:
        return None
    byte_of = {c: x for x, c in byte_alphabet().items()}
    ta = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    tb = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        tb.append((i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()))
    raw = (" " + text).encode()
    return (ta, tb) if b"".join(x[1] for x in ta) == raw == b"".join(x[1] for x in tb) else None


def aligned(pair):
    """(groups text, links) byte by byte."""
    owner = [[k for k, (_, x) in enumerate(side) for _ in x] for side in pair]
    links, seen = [], set()
    for p, (i, j) in enumerate(zip(*owner)):
        if (i, j) not in seen:
            seen.add((i, j))
            links.append((pair[0][i][0], pair[1][j][0]))
    groups, now = [], ([], [])
    for p, (i, j) in enumerate(zip(*owner)):
        last = [p + 1 == len(owner[0]) or o[p + 1] != o[p] for o in owner]
        for side, (k, end) in enumerate(zip((i, j), last)):
            if end:
                now[side].append(str(pair[side][k][0]))
        if all(last):
            groups.append(",".join(now[0]) + "|" + ",".join(now[1]))
            now = ([], [])
    return groups, links


def brute(libraries, texts):
    done = [None if (t := tokens(libraries, x)) is None else (len(t[0]), len(t[1]), *aligned(t)) for x in texts]
    counts = Counter(p for d in done if d for p in d[3])
    most = {}
    for (a, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    out = []
    for d in done:
        if d is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n = [counts[p] for p in d[3]]
            out.append((d[0], d[1], len(d[2]), len(n), sum(counts[p] == most[p[1]] for p in d[3]), sum(n),
                        hashlib.sha256(";".join(d[2]).encode()).hexdigest()))
    return out


def odd_texts():
    rnd = random.Random(3)
    out = [None, "", " ", "\n", "a▁b", "  two  spaces ", "<|endoftext|><s></s><unk><0x0A>", "ꙮ\U000e0041x", "\U0001f600\U0001f600 café",
           "a" + " " * 50 + "b", "\x00\x01 \x7f", "中文字符 ﬁ", "é​﻿", " \x85\r\n\t", "x" * 3000]
    alphabet = "abc  \n\té中ꙮ\U0001f600'1_-" * 3 + "eta oin shr"
    out += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 120))) for _ in range(120)]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 0x500), rnd.randrange(0x2000, 0x3100), rnd.randrange(0x1F300, 0x1F700)]))
                    for _ in range(40)) for _ in range(40)]
    return out


def rows_of(df):
    return sorted(((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)) for r in df.collect()), key=repr)


def test_equals_brute_force(spark, libraries):
    texts = odd_texts() + [r[1] for r in edge_rows() if len(r[1] or "") < 5000]
    want = sorted(enumerate(brute(libraries, texts)), key=repr)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sum(w[1][0] > 0 for w in want) > 150 and sum(w[1][0] == 0 for w in want) > 5
    # one block a task, and blocks of a few texts
    assert rows_of(alignment.align_tokenizers(docs, A, B)) == want
    assert rows_of(alignment.align_tokenizers(docs, A, B, block_chars=300)) == want


def test_chunks_change_nothing(libraries):
    tok = alignment.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    assert tok.can_cut
    rnd = random.Random(8)
    text = " ".join(rnd.choice(["the", "x1", "naïve", "中文", "don't", "\n", "a", "Data", "Straße", "", "\x1c", "3.", "...", "\xa0y"])
                    for _ in range(3000))
    groups, links = aligned(tokens(libraries, text))
    for size in (1, 200, 10 ** 6):
        known = alignment.Chunks(tok)
        chunks = [c for cs in alignment.cut(text, True, size) for c in cs]
        assert "".join(chunks) == " " + text and len(chunks) > 1000
        known.learn(dict.fromkeys(chunks))
        ks = [known.number[c] for c in chunks]
        assert "".join([known.texts[k] for k in ks])[:-1] == ";".join(groups)
        assert sum(known.sizes()[k][2] for k in ks) == len(groups)
        assert [divmod(int(p), len(tok.bytes_b)) for p in known.links_of(ks)] == links
    # one chunk that cannot be encoded does not touch its neighbours
    known = alignment.Chunks(tok)
    known.learn([" a", " b▁c", " d"])
    assert known.unsound == {known.number[" b▁c"]} and [bool(known.texts[known.number[c]]) for c in (" a", " d")] == [True, True]
    assert list(alignment.cut("x" * 1000, True, 200)) == [[" " + "x" * 1000]] and list(alignment.cut("a b", False)) == [[" a b"]]


def test_trimmed_dictionary(spark, libraries, monkeypatch):
    texts = odd_texts()
    want = sorted(enumerate(brute(libraries, texts)), key=repr)
    tok = alignment.Tokenizers(open(A, "rb").read(), open(B, "rb").read())
    for most, left in ((60, True), (5, False)):
        monkeypatch.setattr(alignment, "KEPT_CHUNKS", most)
        known, got = alignment.Chunks(tok), []
        for k in range(0, len(texts), 25):
            block = alignment.Block(known)
            for t in texts[k:k + 25]:
                block.add(t or "")
            block.flush()
            cols, _ = block.coded()
            got += list(zip(*cols[:5]))
            known.trim(block.times)
            assert len(known.number) <= most
        assert got == [(w[0], w[1], w[2], w[3], w[6]) for _, w in sorted(want)]
        assert bool(known.number) or not left


def test_long_texts(spark, libraries, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["alpha", "beta\n", "中文", "x" * 70, "é,"]) for _ in range(900)), "y" * 5000, "a ▁ " * 400]
    want = brute(libraries, texts)
    known = alignment.Chunks(alignment.Tokenizers(open(A, "rb").read(), open(B, "rb").read()))
    monkeypatch.setattr(alignment, "PIECE_CHARS", 100)
    block = alignment.Block(known)
    for t in texts:
        block.add(t)
    block.flush()
    cols, _ = block.coded()
    assert list(zip(*cols[:5])) == [(w[0], w[1], w[2], w[3], w[6]) for w in want]


def test_edge_rows(edge, nothing, libraries):
    rows = edge.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, b) for r, b in zip(rows, brute(libraries, [r.text for r in rows]))), key=repr)
    assert rows_of(alignment.align_tokenizers(edge, A, B)) == want
    assert alignment.align_tokenizers(nothing, A, B).count() == 0
