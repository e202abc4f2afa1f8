"""Operator 6: n-gram Jaccard join by T-occurrence search (DivideSkip).

A document is the set of its distinct shingles, hashed to 64 bits; documents with equal sets
form one class, and only classes are searched.  ``Rule`` names the words of a shingle (3) and the
percentage p (90) of a link: two classes of n and m shingles are linked when 100 * |both| >=
p * |either|, so each must share at least T = ceil(p n / 100) of its own shingles with the other.  The result is the connected components of the links.

1.  Candidate classes.  Shingles are ordered by hash.  Of T shared shingles, at least l lie among
    the first n - T + l of each side, so a class without that many shingles in other classes'
    lists has no link.  Lists are only counted here; no pair is formed, whatever their length.
2.  Inverted lists over the candidates, with their exact lengths.  Shingles of a list of one
    cannot be shared.  A class with s shared shingles needs s >= T.  Its shingles are put in
    order of list length: the T - 1 longest lists are the long ones of DivideSkip, the s - T + 1
    shortest the short ones.  Linked classes meet in at least T(n, m) - max(long) short lists.
3.  Leaders.  In every short list all classes are compared with one, that of the largest share
    s / n (the most central copy of a family): as many comparisons as list entries.  Links join
    components.
4.  The rest, exactly.  Pairs inside one component need no further link.  Lists that still hold
    several components are searched: each class outside the list's largest component merges
    its short lists with a heap, counts occurrences, probes its longest lists by binary
    search, and keeps the classes of other components that reach the required overlap.  Lists
    are stored in blocks of bounded size, so no task holds a whole long list.
5.  Candidates of 3 and 4 are verified by binary probes over the whole sorted shingle sets.

Words split at space and U+0009 to U+000D, A to Z are lowered.  Texts of fewer words than a
shingle are one shingle; texts without words and null texts have an empty set and are linked with
nothing.  A null id is a document of its own class rules; components take the smallest id that
is not null (null when there is none).  Rows equal in id and text are two documents of one
class.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnspark.llm._shared import col, fresh, row_key, staged, table, text_or_empty

#: Share of a set that the candidate test reads, in thousandths: the part that linked sets may differ
#: in, and beyond it the shingles that must be found shared.
READ = 300
#: Entries of one block of an inverted list.
BLOCK = 20_000
#: Word hashes kept by a task.
KEPT_WORDS = 400_000


@dataclass(frozen=True)
class Rule:
    """``words`` of a shingle (up to 6); links hold at 100 * |both| >= ``percent`` * |either|."""

    words: int = 3
    percent: int = 90

    def least_overlap(self, n):
        """T: shingles that a set of n must share with any linked set."""
        return -(-self.percent * n // 100)

    @property
    def thousandths(self) -> int:
        return max(50, READ - 10 * (100 - self.percent))

    def evidence(self, n):
        """l: shared shingles looked for among the first n - T + l of the set."""
        return np.maximum(1, n * self.thousandths // 1000)


# -- shingles ---------------------------------------------------------------------------

class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h


_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA24BAED4963EE407,
                             0x9FB21C651E98DF25, 0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, known: _WordHashes, size: int = 3) -> np.ndarray:
    """Sorted distinct shingle hashes (signed 64-bit) of a whole text."""
    words = text.encode().lower().split()
    n = len(words)
    if len(known) > KEPT_WORDS:
        known.clear()
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    if n >= size:
        x = h[:n - size + 1] * _ODD[0]
        for k in range(1, size):
            x += h[k:n - size + 1 + k] * _ODD[k]
    elif n:
        x = (h * np.array(_ODD[:n])).sum(keepdims=True, dtype=np.uint64) + _ODD[-1] * np.uint64(n)
    else:
        return np.empty(0, dtype=np.int64)
    return np.unique(_mixed(x).view(np.int64))


def _prefixes(rule: Rule):
    def run(batches):
        known = _WordHashes()
        for batch in batches:
            n, d1, d2, prefix = [], [], [], []
            for text in batch.column("t").to_pylist():
                s = shingles(text, known, rule.words)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                n.append(len(s))
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                prefix.append(s[:len(s) - rule.least_overlap(len(s)) + int(rule.evidence(len(s)))] if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(d1, pa.int64()),
                 pa.array(d2, pa.int64()), pa.array(prefix, pa.list_(pa.int64()))],
                names=["id", "th", "n", "d1", "d2", "prefix"])

    return run


def _sets(rule: Rule):
    def run(batches):
        known = _WordHashes()
        for batch in batches:
            sets = [shingles(t, known, rule.words) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rec"), pa.array(sets, pa.list_(pa.int64()))], names=["rec", "tokens"])

    return run


# -- verification and search, on plain arrays ----------------------------------------------

def probe(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays: binary probes of the smaller's values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())


def divide_skip(lists: list[list[int]], need: int) -> dict[int, int]:
    """T-occurrence search: the values that occur in at least ``need`` of the sorted lists, with
    their counts.  The longest lists, at most need - 1, are put aside; the others are merged
    with a heap, and a value found often enough there is probed in the long ones."""
    lists = sorted((x for x in lists if x), key=len)
    n_long = max(0, min(need - 1, len(lists) - 1, len(lists) // 2))
    short, long = lists[:len(lists) - n_long], lists[len(lists) - n_long:]
    found: dict[int, int] = {}
    merged = heapq.merge(*short)
    value = next(merged, None)
    while value is not None:
        count, after = 1, next(merged, None)
        while after == value:
            count, after = count + 1, next(merged, None)
        if count + n_long >= need:
            for x in long:
                k = bisect_left(x, value)
                count += k < len(x) and x[k] == value
            if count >= need:
                found[value] = count
        value = after
    return found


def _verify(rule: Rule):
    def run(batches):
        for batch in batches:
            a, b = batch.column("ta"), batch.column("tb")
            keep = []
            va, vb, oa, ob = a.flatten().to_numpy(), b.flatten().to_numpy(), a.offsets.to_numpy(), b.offsets.to_numpy()
            oa, ob = oa - oa[0], ob - ob[0]
            for k in range(len(batch)):
                x, y = va[oa[k]:oa[k + 1]], vb[ob[k]:ob[k + 1]]
                both = probe(x, y)
                keep.append(100 * both >= rule.percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _search(rule: Rule):
    def run(key, pdf):
        """One query class against one block number of its lists."""
        q = pdf.iloc[0]
        n, s, comp = int(q.n), int(q.s), int(q.comp)
        recs = [np.asarray(x) for x in pdf["recs"]]
        comps, ns, ss = (np.concatenate([np.asarray(x) for x in pdf[c]]) for c in ("comps", "ns", "ss"))
        every = np.concatenate(recs)
        ns, ss = ns.astype(np.int64), ss.astype(np.int64)
        most = np.minimum(s, ss)
        able = (comps != comp) & (100 * most >= rule.percent * (n + ns - most))
        total = -(-rule.percent * (n + ns) // (100 + rule.percent))
        need = np.maximum(1, total - np.maximum(rule.least_overlap(n), rule.least_overlap(ns)) + 1)
        out = []
        if able.any():
            ends = np.cumsum([len(x) for x in recs])[:-1]
            lists = [np.sort(x[m]).tolist() for x, m in zip(recs, np.split(able, ends))]
            wanted = dict(zip(every[able].tolist(), need[able].tolist()))
            out = [r for r, c in divide_skip(lists, min(wanted.values())).items() if c >= wanted[r]]
        return pd.DataFrame({"a": np.full(len(out), int(key[0]), dtype=np.int64), "b": np.array(out, dtype=np.int64)})

    return run


# -- components ----------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, by alternating large-star and
    small-star steps.  Each step is two partial aggregations and joins on the node; a hub's
    rows are split by the skew join.  The edges of a step are written to the shared folder."""
    def larger(e: DataFrame) -> DataFrame:
        sym = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = sym.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        return sym.join(low, sym["a"] == low["c"]).filter(F.col("b") > F.col("a")).select(
            F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()

    def smaller(e: DataFrame) -> DataFrame:
        low = e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), "m")
        near = e.join(low, e["a"] == low["c"])
        rest = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b")))
        return rest.filter("a <> b").distinct()

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    e = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    now = state(e)
    while now[0]:
        nxt = staged(smaller(larger(e)), "edges")
        then = state(nxt)
        if then == now:
            break
        e, now = nxt, then
    # a star: every node of a component points to its smallest
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


# -- the join ------------------------------------------------------------------------------

def _bound(rule: Rule, n: str, s: str, m: str, o: str):
    """Can sets of n and m shingles, s and o of them shared by anyone, be linked?"""
    n, s, m, o = (F.col(c).cast("long") for c in (n, s, m, o))
    k = F.least(s, o)
    return 100 * k >= rule.percent * (n + m - k)


def candidate_classes(reps: DataFrame, rule: Rule) -> DataFrame:
    """Step 1: classes (rec, n, id, th) with enough shared shingles in their prefixes."""
    posts = reps.select("rec", F.explode("prefix").alias("token"))
    shared = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").select("token")
    hits = posts.join(shared, "token").groupBy("rec").agg(F.count(F.lit(1)).alias("hits"))
    # a linked set has at least p n / 100 shingles, and so its own l at least that share of this one's
    need = F.greatest(F.lit(1), F.expr(f"bigint(n) * {rule.thousandths * rule.percent} div 100000"))
    return reps.drop("prefix").join(hits, "rec").filter(F.col("hits") >= need).drop("hits")


def short_lists(sets: DataFrame, rule: Rule) -> DataFrame:
    """Step 2: (rec, n, s, token): the short lists of each class that can have a link."""
    posts = sets.select("rec", F.explode("tokens").alias("token"))
    df = posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = posts.join(df, "token").groupBy("rec").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))
    own = own.join(sets.select("rec", F.size("tokens").alias("n")), "rec").withColumn("s", F.size("own"))
    t = F.ceil(F.col("n").cast("long") * rule.percent / 100).cast("int")
    own = own.filter(F.col("s") >= t)
    return own.select("rec", "n", "s", F.explode(F.slice("own", 1, F.col("s") - t + 1)).alias("x")).select(
        "rec", "n", "s", F.col("x.token").alias("token"))


def verified(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (a, b) that are linked.  Each set travels once per pair it is in."""
    one = sets.select(F.col("rec").alias("a"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("rec").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(rule), "a bigint, b bigint")


def leader_pairs(lists: DataFrame, rule: Rule) -> DataFrame:
    """Step 3: every class of a list with the list's most central class."""
    centre = F.struct((-F.col("s") / F.col("n")).alias("x"), F.col("rec").alias("b"), F.col("n").alias("m"), F.col("s").alias("o"))
    lead = lists.groupBy("token").agg(F.min(centre).alias("l"), F.count(F.lit(1)).alias("len")).filter("len > 1")
    pairs = lists.join(lead.select("token", "l.*"), "token").filter((F.col("rec") != F.col("b")) & _bound(rule, "n", "s", "m", "o"))
    return pairs.select(F.least("rec", "b").alias("a"), F.greatest("rec", "b").alias("b")).distinct()


def remaining_pairs(lists: DataFrame, comps: DataFrame, rule: Rule) -> DataFrame:
    """Step 4: candidate pairs (a, b) of different components."""
    lists = staged(lists.join(comps.select(F.col("node").alias("rec"), "root"), "rec", "left").select(
        "rec", "n", "s", "token", F.coalesce("root", "rec").alias("comp")), "lists")
    each = lists.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("k"))
    mixed = staged(each.groupBy("token").agg(F.count(F.lit(1)).alias("parts"), F.sum("k").alias("len"),
                                             F.max_by("comp", F.struct("k", "comp")).alias("major"))
                   .filter("parts > 1").select("token", "len", "major"), "mixed")
    longest = mixed.agg(F.max("len")).first()[0] or 1
    blocks = -(-longest // BLOCK)
    entries = lists.join(mixed, "token")
    asking = entries.filter("comp <> major").select("rec").distinct()
    entry = F.struct("rec", "comp", "n", "s")
    inverted = entries.withColumn("block", F.pmod(F.xxhash64("rec"), F.lit(blocks))).groupBy("token", "block").agg(
        F.sort_array(F.collect_list(entry)).alias("l"))
    inverted = inverted.select("token", "block", F.col("l.rec").alias("recs"), F.col("l.comp").alias("comps"),
                               F.col("l.n").alias("ns"), F.col("l.s").alias("ss"))
    asked = entries.join(asking, "rec", "left_semi").select("rec", "n", "s", "comp", "token").join(inverted, "token")
    found = asked.groupBy("rec", "block").applyInPandas(_search(rule), "a bigint, b bigint")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """One row per input row: ``id``, ``th``, ``n`` (set size), ``rec`` (class, null for empty
    sets), ``comp`` (smallest class number of the component) and ``component_id``."""
    base = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("t"))
    kind = base.schema["id"].dataType.simpleString()
    prints = staged(base.mapInArrow(_prefixes(rule), f"id {kind}, th bigint, n int, d1 bigint, d2 bigint, prefix array<bigint>"),
                    "prints")
    reps = prints.filter("n > 0").groupBy("d1", "d2").agg(
        F.min("id").alias("least_id"), F.min(F.struct("id", "th")).alias("rep"), F.first("n").alias("n"),
        F.first("prefix").alias("prefix"))
    reps = staged(reps.select(F.monotonically_increasing_id().alias("rec"), "d1", "d2", "least_id", "rep.id", "rep.th",
                              "n", "prefix"), "classes")

    chosen = staged(candidate_classes(reps.select("rec", "id", "th", "n", "prefix"), rule), "candidates")
    # the list of candidates grows with the input: a sort-merge join at every size, no broadcast
    wanted = chosen.select("rec", F.col("id").alias("c_id"), F.col("th").alias("c_th")).hint("merge")
    texts = base.join(wanted, F.col("id").eqNullSafe(F.col("c_id")) & (F.col("th") == F.col("c_th"))).select("rec", "t")
    sets = texts.mapInArrow(_sets(rule), "rec bigint, tokens array<bigint>")
    if not prints.groupBy("id", "th").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").isEmpty():
        # rows equal in id and text give a class twice
        sets = sets.groupBy("rec").agg(F.first("tokens").alias("tokens"))
    sets = staged(sets, "sets")

    lists = staged(short_lists(sets, rule), "short")
    links = staged(verified(leader_pairs(lists, rule), sets, rule), "links")
    comps = components(links)
    more = verified(remaining_pairs(lists, comps, rule), sets, rule)
    # the components found so far stand for their links
    known = comps.select(F.col("node").alias("a"), F.col("root").alias("b"))
    comps = components(known.unionByName(more))

    label = reps.select("rec", "d1", "d2", "least_id").join(comps.withColumnRenamed("node", "rec"), "rec", "left")
    label = label.withColumn("comp", F.coalesce("root", "rec")).drop("root")
    least = label.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    label = label.join(least, "comp").select("d1", "d2", "rec", "comp", "component_id")
    some = prints.filter("n > 0").select("id", "th", "n", "d1", "d2").join(label, ["d1", "d2"])
    none = prints.filter("n = 0").select("id", "th", "n", F.lit(None).cast("long").alias("rec"),
                                         F.lit(None).cast("long").alias("comp"), F.col("id").alias("component_id"))
    return some.select(*none.columns).unionByName(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The input rows and columns of one document per component: the row of the smallest id,
    then of the smallest text hash, then of the smallest other columns.  Documents without
    words are each their own component."""
    found = staged(similar_documents(docs, id_col, text_col, rule), "components")
    some = found.filter("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th")
    some = some.withColumn("only", F.lit(True))
    none = found.filter("comp IS NULL").select("id", "th").distinct().withColumn("only", F.lit(False))
    names = {c: fresh(docs, c) for c in ("id", "th", "only", "nth")}
    keep = some.unionByName(none).select(*[F.col(c).alias(names[c]) for c in ("id", "th", "only")])
    th = F.xxhash64(F.lit("t"), col(text_col))
    both = docs.withColumn(names["nth"], th).join(
        keep, col(id_col).eqNullSafe(col(names["id"])) & (col(names["nth"]) == col(names["th"])))
    order = [F.to_json(F.struct(*[col(c) for c in docs.columns if c != text_col]))]
    nth = F.row_number().over(Window.partitionBy(col(names["id"]), col(names["th"])).orderBy(*order))
    both = both.withColumn(names["nth"], nth).filter((col(names["nth"]) == 1) | ~col(names["only"]))
    return both.select(*[col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "component_id")
