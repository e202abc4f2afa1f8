"""Plain single-process versions of the training-data operators, for small fixtures."""

from __future__ import annotations

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def deleted_lines(docs: list[tuple], min_words: int) -> dict[int, set[int]]:
    """Row number -> deleted line numbers.  ``docs``: (order key, text); compares every line with
    every earlier place of an equal line and follows both as far as they agree."""
    seqs = []
    for row, (key, text) in sorted(enumerate(docs), key=lambda x: x[1][0]):
        ls = (text or "").split("\n")
        seqs.append((row, [(i, x, len(WORD.findall(x))) for i, x in enumerate(ls) if WORD.search(x)]))
    places: dict[str, list[tuple]] = defaultdict(list)
    out: dict[int, set[int]] = defaultdict(set)
    for row, seq in seqs:
        for i in range(len(seq)):
            for other, j in places[seq[i][1]]:
                n = words = 0
                while i + n < len(seq) and j + n < len(other) and seq[i + n][1] == other[j + n][1]:
                    words += seq[i + n][2]
                    n += 1
                if words >= min_words:
                    out[row].update(x[0] for x in seq[i:i + n])
            places[seq[i][1]].append((seq, i))
    return out


def shingle_set(text: str | None, size: int = 3) -> frozenset:
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < size:
        return frozenset([tuple(words)] if words else [])
    return frozenset(zip(*[words[k:] for k in range(size)]))


def components(sets: list[frozenset], percent: int = 90) -> list[int]:
    """Component of each set (its smallest index), from all pairs."""
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b:
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


def base_spans(text: str | None) -> list[tuple[int, int, int, str]]:
    text = text or ""
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                         text, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def quality(text: str | None) -> dict:
    t = text or ""
    words = WORD.findall(t)
    n = len(words)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    where = defaultdict(list)
    for i in range(n - 7):
        where[tuple(words[i:i + 8])].append(i)
    covered = {k for v in where.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    m = {"n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)),
         "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}
    m["base_failed"] = n < 20 or 100 * len(covered) > 30 * n
    return m
