import hashlib

import regex

from churnspark.llm import licenses


def test_equivalent_texts_match(spark):
    mit = licenses.KNOWN["MIT"]
    variant = mit.replace("<year> <copyright holders>", "1999 Someone Else").upper().replace(",", "").replace("SUBLICENSE", "SUB-LICENCE")
    rows = [(1, mit), (2, variant + "\n\n"), (3, mit + "\nand more words"), (4, "x\n// Released under the MIT Licence!\ny"),
            (5, None), (6, ""), (7, "Copyright (c) 2020 A B"), (8, "We speak of copyright 2 times"),
            (9, "Licensed under the Apache License, Version 2.0.")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].license == got[2].license == "MIT" and got[3].license is None
    assert got[4].notices == ["MIT-notice"] and got[4].license is None
    assert got[9].license == "Apache-2.0-notice" and got[9].notices == ["Apache-2.0-notice"]
    assert got[5].digest == got[6].digest == got[7].digest != got[8].digest
    assert all(got[k].license is None for k in (5, 6, 7, 8))


def test_own_texts_and_edge_rows(edge, nothing, spark):
    docs = spark.createDataFrame([(1, "Do what you like."), (2, "no")], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs, texts={"free": "do what you like", "blank": "!"}).collect()}
    assert got[1].license == "free" and got[1].notices == ["free"] and got[2].license is None
    assert licenses.scan(edge).count() == edge.count() and licenses.scan(nothing).count() == 0
    assert licenses.scan(docs, texts={"blank": "..."}).filter("license IS NOT NULL").count() == 0


def brute(text, texts):
    """Canonical form, whole-text and block lookup, written with another regular expression engine."""
    def canon(t):
        marks = "[ \\t/*#;<!-]*"
        start = r"(?:\A|(?<=[\n\r\x85\u2028\u2029]))"
        t = regex.sub(start + marks + r"(?:(?:copyright|\(c\)|©)[ \t]*(?:\(c\)|©|[0-9]{4}|by\b|<)|all rights reserved)[^\n]*",
                      "", t.lower())
        head, _, rest = t.lstrip(" \t\n\x0b\f\r").partition("\n")
        name = head.strip(" \t\r/*#;<!-:.=")
        if regex.fullmatch(r"(the[ \t]+)?(mit|isc|zlib|bsd zero clause|zero-clause bsd|0bsd)[ \t]+licen[sc]e([ \t]*\([a-z0-9/ -]+\))?", name):
            t = rest
        for a, b in licenses.SPELLINGS:
            t = regex.sub(a, b, t)
        return regex.sub(r"[^\p{L}\p{N}]+", " ", t).strip()
    known = {}
    for name in sorted(texts):
        if canon(texts[name]):
            known.setdefault(canon(texts[name]), name)
    text = text or ""
    lines, paragraphs, part = text.split("\n"), [], []
    for line in [*lines, ""]:
        if line.strip(" \t\r/*#;-"):
            part.append(line)
        else:
            paragraphs += [part] if len(part) > 1 else []
            part = []
    blocks = lines + ["\n".join(p) for p in paragraphs]
    return (hashlib.sha256(canon(text).encode()).hexdigest(), known.get(canon(text)),
            [known[canon(b)] for b in blocks if canon(b) in known])


def test_equal_to_brute_force(edge, spark):
    mit, isc = licenses.KNOWN["MIT"], licenses.KNOWN["ISC"]
    body = mit.split("\n\n", 1)[1]
    header = licenses.KNOWN["Apache-2.0-header-short"]
    made = [*licenses.KNOWN.values(), body, "The MIT License (MIT)\n\n" + body, "# MIT Licence:\r\n" + body, "MIT License",
            "MIT License\n", "The MIT License is short\n" + body, isc.lower(), mit + "\n\n" + isc, "  \n\nISC License\n" + isc.split("\n\n", 1)[1],
            "int x;\n#\n" + "\n".join("# " + x for x in header.split("\n")) + "\n#\ny", header + "\nmore", "a\n\n" + header,
            "/*\n * " + header.replace("\n", "\n * ") + "\n */\ncode", "one\n\n\n\ntwo licence\nlines\n\n" + body.split("\n\n")[1], "\n", "#\n"]
    docs = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")
    for frame in (docs, edge):
        want = sorted((str(r.doc_id), *brute(r.text, licenses.KNOWN)[:1], str(brute(r.text, licenses.KNOWN)[1:]))
                      for r in frame.select("doc_id", "text").collect())
        got = sorted((str(r.doc_id), r.digest, str((r.license, list(r.notices)))) for r in licenses.scan(frame).collect())
        assert got == want
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    n = len(licenses.KNOWN)
    assert [got[n + k].license for k in range(6)] == ["MIT", "MIT", "MIT", None, None, None]
    assert got[n + 9].notices == got[n + 11].notices == got[n + 12].notices == ["Apache-2.0-header-short"]
    assert got[n + 10].notices == []
