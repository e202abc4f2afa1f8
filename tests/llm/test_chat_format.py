import hashlib
import itertools
import random

from churnspark.llm import chat_format as C


def read_back(formatted):
    """The grammar read by hand: control strings after a backslash are content."""
    turns, at = [], 0
    while at < len(formatted):
        assert formatted.startswith("[INST] ", at)
        a = formatted.index(" [/INST]\n", at)
        b = formatted.index("\n</s>\n", a)
        turns.append((formatted[at + 7:a], formatted[a + 9:b]))
        at = b + 6
    import re
    un = lambda s: re.sub(r"\\(\\*(?:\[INST\]|\[/INST\]|</s>))", r"\1", s)
    return [(un(r), un(t)) for r, t in turns]


def test_adversarial_texts_round_trip(spark):
    bits = ["</s>", "[INST]", "[/INST]", "\\", "\n", " ", "x", "[INST", "</s", "\\</s>", "\n</s>\n", "é"]
    rnd = random.Random(7)
    texts = ["".join(p) for p in itertools.product(bits, repeat=2)] + ["".join(rnd.choices(bits, k=8)) for _ in range(200)] + [None, ""]
    rows = [(k // 3, k % 3, rnd.choice(["user", "assistant", "system", "a</s>b", "\\", None]), t) for k, t in enumerate(texts)]
    conv = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = C.format_conversations(conv)
    full = {r.conv_id: r for r in out.collect()}
    short = {r.conv_id: r for r in C.digests(out).collect()}
    for c in full:
        src = [(r or "", t or "") for i, _, r, t in rows if i == c]
        assert read_back(full[c].formatted) == src and full[c].round_trip
        d = short[c]
        loss = "".join(t for r, t in src if r == "assistant")
        assert d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in src).encode()).hexdigest()
        assert (d.n_turns, d.loss_chars, d.loss_sha256) == (len(src), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert d.formatted_chars == len(full[c].formatted)


def test_plain_texts_are_not_escaped_and_control_strings_are(spark):
    conv = spark.createDataFrame([(1, 0, "user", "a\\b"), (-1, 0, "user", C.PROBE_TEXT), (-1, 1, "assistant", C.PROBE_TEXT)],
                                 "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in C.format_conversations(conv).collect()}
    assert not got[1].escaped and got[1].formatted == "[INST] user [/INST]\na\\b\n</s>\n"
    assert got[-1].escaped and got[-1].round_trip and "\n\\</s>\\[INST] ok \\[/INST]\n" in got[-1].formatted


def test_ties_nulls_extra_columns_and_no_rows(spark):
    conv = spark.createDataFrame([(None, 1, "user", "b"), (None, None, "user", "a"), (2, 1, "user", "same"), (2, 1, "user", "same"),
                                  (2, 1, "assistant", None), (3, 0, "user", "long " * 100_000)],
                                 "conv_id long, turn int, role string, text string").selectExpr("*", "'x' AS formatted", "'y' AS t", "1 AS parsed")
    got = {r.conv_id: r for r in C.format_conversations(conv).collect()}
    assert [x.text for x in got[None].parsed] == ["a", "b"] and [x.text for x in got[2].parsed] == ["", "same", "same"]
    assert got[3].round_trip and len(got[3].formatted) > 500_000
    assert C.digests(C.format_conversations(conv.limit(0))).count() == 0
