"""Operator 1: line dedup with a suffix array over line-ID sequences.

A document is the sequence of its non-blank lines.  A *run* is a stretch of consecutive
non-blank lines of one document with ``min_words`` words or more in all.  A run that also
stands at an earlier place of the corpus is a later copy, and its lines are deleted.  Earlier
means: smaller id, then smaller text hash, then earlier line.

1.  Line IDs.  Lines are hashed to 128 bits; lines that the corpus holds twice or more get
    their rank in the order of hashes.  A line that is unique ends every repeated run, so
    documents fall into segments of repeated lines, and segments below ``min_words`` go.
2.  Prefix doubling.  The rank of the prefix of 2h lines at a position is the place of the pair
    (rank at it, rank h lines further) among all pairs in order.  Positions whose pair is
    unique are settled and leave.  Ranks of one depth are the suffix array cut at that depth:
    suffixes with one rank stand side by side and share that many lines.
3.  LCP intervals.  For a depth of n lines, with h the power of two below, suffixes agree on n
    lines when they agree in rank at depth h at the start and n - h lines further.  Such a set
    is an interval of suffixes whose longest common prefix is n or more.  The depths that
    matter are content-defined: at each line the shortest run of ``min_words`` words that
    starts there, and the shortest that ends there.  Every run with an earlier copy is the
    union of such shortest runs inside it (a line less than ``min_words`` from its end lies in
    the shortest run that ends there), and each of these has an earlier copy too.  So the
    non-first members of the intervals, taken together, are exactly the lines of all maximal
    repeated runs, and doubling ends at ``min_words`` lines whatever the corpus holds.

Lines compare exactly.  Blank lines are never deleted and do not end a run.  Null and empty
texts stay as they are.  Rows equal in id and text are one document and get the same result.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnspark.llm._shared import WORD_RE, WS_CHARS, col, fresh, row_key, staged, table, text_or_empty
from churnspark.operators.rows import positions

MIN_WORDS = 50
#: An interval with more than one in HOT of all suffixes is hot: there are fewer than HOT of these.
HOT = 1000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per non-blank line: (id, th, seq, line, a, b, w), where ``seq`` counts non-blank
    lines, ``line`` all lines from 0, (a, b) is the line's hash and ``w`` its words."""
    base = docs.select(*row_key(id_col, text_col), text_or_empty(text_col).alias("t"))
    numbered = F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("line"), x.alias("x")))
    full = F.filter(numbered, lambda s: F.btrim(s["x"], F.lit(WS_CHARS)) != "")
    one = base.select("id", "th", F.posexplode(full).alias("seq", "s"))
    return one.select("id", "th", "seq", F.col("s.line").alias("line"), F.xxhash64("s.x").alias("a"),
                      F.xxhash64(F.lit("b"), "s.x").alias("b"),
                      F.regexp_count(F.col("s.x"), F.lit(WORD_RE)).alias("w"))


def segments(all_lines: DataFrame, min_words: int) -> DataFrame:
    """Stretches of lines that the corpus repeats: (id, th, seg, seq, line, w, r), where ``r`` is
    the line's rank among repeated lines."""
    often = all_lines.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a", "b")
    ranked = positions(often, ["a", "b"], name="r")
    found = all_lines.join(ranked, ["a", "b"]).select("id", "th", "seq", "line", "w", "r")
    doc = Window.partitionBy("id", "th").orderBy("seq")
    # rows equal in id and text give every line twice
    found = found.withColumn("before", F.lag("seq").over(doc)).filter("before IS NULL OR before < seq")
    found = found.withColumn("seg", F.col("seq") - F.dense_rank().over(doc)).drop("before")
    found = found.withColumn("total", F.sum("w").over(Window.partitionBy("id", "th", "seg")))
    return staged(found.filter(F.col("total") >= min_words).drop("total"), "segments")


def shortest_runs(segs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, seg, seq, n): the shortest runs of ``min_words`` words from each line on, and up
    to each line.  Every line has a word, so running word counts are distinct keys and a range
    frame over them holds exactly the lines of the run."""
    part = ["id", "th", "seg"]
    upto = Window.partitionBy(*part).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = segs.select(*part, "seq", "w", F.sum("w").over(upto).alias("after"))
    rows = rows.withColumn("prior", F.col("after") - F.col("w"))
    ahead = Window.partitionBy(*part).orderBy("prior").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*part).orderBy("after").rangeBetween(1 - min_words, 0)
    one = F.count(F.lit(1))
    rows = rows.select(*part, "seq", one.over(ahead).alias("nf"), F.sum("w").over(ahead).alias("wf"),
                       one.over(back).alias("nb"), F.sum("w").over(back).alias("wb"))
    fore = F.when(F.col("wf") >= min_words, F.struct(F.col("seq").alias("seq"), F.col("nf").cast("int").alias("n")))
    rear = F.when(F.col("wb") >= min_words, F.struct(
        (F.col("seq") - F.col("nb") + 1).cast("int").alias("seq"), F.col("nb").cast("int").alias("n")))
    each = rows.select(*part, F.explode(F.array_compact(F.array(fore, rear))).alias("x"))
    return each.select(*part, "x.seq", "x.n").distinct()


def doubled(ranks: DataFrame, h: int) -> DataFrame:
    """Ranks at depth h -> ranks at depth 2h of the positions that still share theirs."""
    there = Window.partitionBy("id", "th", "seg").orderBy("seq").rangeBetween(h, h)
    pairs = ranks.withColumn("r2", F.max("r").over(there)).filter("r2 IS NOT NULL")
    shared = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "r2")
    named = positions(shared, ["r", "r2"], name="r_new")
    return pairs.join(named, ["r", "r2"]).select("id", "th", "seg", "seq", F.col("r_new").alias("r"))


def _on(left: DataFrame, right: DataFrame, prefix: str, extra):
    cond = extra
    for k in ("id", "th", "seg"):
        cond = cond & left[k].eqNullSafe(right[f"{prefix}{k}"])
    return cond


def copies(segs: DataFrame, min_words: int) -> DataFrame:
    """(id, th, seg, seq, n): shortest runs that are not the first of their LCP interval."""
    runs = staged(shortest_runs(segs, min_words), "runs")
    deepest = runs.agg(F.max("n").alias("n")).first().n or 0
    level = segs.select("id", "th", "seg", "seq", "r")
    h, levels = 1, []
    while True:
        levels.append(level.withColumn("h", F.lit(h)))
        if 2 * h > deepest:
            break
        level = staged(doubled(level, h), f"ranks-{2 * h}")
        h *= 2
    known = levels[0]
    for one in levels[1:]:
        known = known.unionByName(one)
    runs = runs.withColumn("h", F.expr(" + ".join(["1"] + [f"IF(n >= {2 ** k}, {2 ** k - 2 ** (k - 1)}, 0)" for k in range(1, len(levels))])))

    def at(prefix: str, rank: str) -> DataFrame:
        return known.select(*[F.col(c).alias(f"{prefix}{c}") for c in ("id", "th", "seg", "seq", "h")], F.col("r").alias(rank))

    a, b = at("a_", "ra"), at("b_", "rb")
    full = runs.join(a, _on(runs, a, "a_", (runs["h"] == a["a_h"]) & (runs["seq"] == a["a_seq"])))
    full = full.select(*runs.columns, "ra")
    full = full.join(b, _on(full, b, "b_", (full["h"] == b["b_h"]) & (full["seq"] + full["n"] - full["h"] == b["b_seq"])))
    full = staged(full.select("id", "th", "seg", "seq", "n", "ra", "rb"), "intervals")
    return later(full)


def later(runs: DataFrame) -> DataFrame:
    """The members of each interval (n, ra, rb) but its first.  Hot intervals meet their first
    member by a broadcast of fewer than HOT rows, the others by a shuffle in which no key
    holds more than one in HOT of the rows."""
    key = ["n", "ra", "rb"]
    firsts = staged(runs.groupBy(*key).agg(F.min(F.struct("id", "th", "seq")).alias("first"),
                                           F.count(F.lit(1)).alias("size")).filter("size > 1"), "firsts")
    bound = (firsts.agg(F.sum("size")).first()[0] or 0) // HOT
    hot = firsts.filter(F.col("size") > bound).select(*key, "first")
    cold = firsts.filter(F.col("size") <= bound).select(*key, "first")
    met = runs.join(F.broadcast(hot), key, "left")
    rest = met.filter("first IS NULL").drop("first").join(cold.hint("merge"), key)
    both = met.filter("first IS NOT NULL").unionByName(rest)
    return both.filter(~F.struct("id", "th", "seq").eqNullSafe(F.col("first"))).select("id", "th", "seg", "seq", "n")


def deletions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """One row per document that loses lines: (id, th, runs), where ``runs`` are the deleted
    stretches of lines (s, e), counted from 0, the end exclusive."""
    segs = segments(staged(lines(docs, id_col, text_col), "lines"), min_words)
    # where runs begin and end; a line is deleted where more have begun than ended
    ends = copies(segs, min_words).select("id", "th", F.explode(F.array(
        F.struct(F.col("seq"), F.lit(1).alias("d")),
        F.struct((F.col("seq") + F.col("n")).alias("seq"), F.lit(-1).alias("d")))).alias("x"))
    ends = ends.groupBy("id", "th", F.col("x.seq").alias("seq")).agg(F.sum("x.d").alias("d")).filter("d <> 0")
    marks = segs.select("id", "th", "seq", "line", F.lit(0).cast("long").alias("d")).unionByName(
        ends, allowMissingColumns=True)
    doc = Window.partitionBy("id", "th").orderBy("seq")
    within = doc.rangeBetween(Window.unboundedPreceding, 0)
    gone = marks.withColumn("open", F.sum("d").over(within)).filter("line IS NOT NULL AND open > 0")
    islands = gone.withColumn("g", F.col("line") - F.row_number().over(doc))
    runs = islands.groupBy("id", "th", "g").agg(F.min("line").alias("s"), (F.max("line") + 1).alias("e"))
    return runs.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("s", "e"))).alias("runs"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
          runs_name: str | None = None) -> DataFrame:
    """The input rows and columns with later copies deleted from the text.  ``runs_name`` adds
    a column with the deleted stretches (null where nothing was deleted)."""
    cut = deletions(docs, id_col, text_col, min_words)
    names = {c: fresh(docs, c) for c in ("id", "th", "runs")}
    cut = cut.select(*[F.col(c).alias(n) for c, n in names.items()])
    th = F.xxhash64(F.lit("t"), col(text_col))
    both = docs.join(cut, col(id_col).eqNullSafe(col(names["id"])) & (th == col(names["th"])), "left")
    runs, split = col(names["runs"]), F.split(col(text_col), "\n")
    # the stretches between deleted runs, each one slice
    kept = F.flatten(F.transform(F.concat(runs, F.array(F.struct(
        F.size(split).alias("s"), F.size(split).alias("e")))), lambda x, i: F.slice(
            split, F.coalesce(F.get(runs, i - 1)["e"], F.lit(0)) + 1,
            x["s"] - F.coalesce(F.get(runs, i - 1)["e"], F.lit(0)))))
    clean = F.when(runs.isNull(), col(text_col)).otherwise(F.concat_ws("\n", kept))
    out = [clean.alias(c) if c == text_col else col(c) for c in docs.columns]
    return both.select(*out, *([runs.alias(runs_name)] if runs_name else []))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup(docs, runs_name="runs")
    deleted = F.aggregate("runs", F.lit(0), lambda a, x: a + x["e"] - x["s"])
    where = F.concat_ws(",", F.transform("runs", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))))
    return out.select("doc_id", F.coalesce(deleted, F.lit(0)).cast("long").alias("n_deleted"),
                      where.alias("deleted"), "text")
