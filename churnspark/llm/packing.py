"""Operator 5: packing into optimal length buckets.

The global histogram of padded lengths goes through a dynamic programme that chooses at most
``n_buckets`` bucket lengths with the least padding in all.  Each document goes to the
smallest bucket that holds it, and inside a bucket documents, numbered in a total order, form
batches of as many sequences as the token budget allows at that length.

Lengths are rounded up to ``multiple``, so the histogram has at most (longest / multiple)
rows however many documents there are; that aggregate alone reaches the driver.  Null and
empty texts have length 0 and take one slot of the smallest bucket; documents longer than the
budget form batches of one; equal lengths share a bucket; repeated rows are packed each; an
empty table gives no rows.  A bucket with a third of all rows is numbered over many
partitions.

The query measures encoded tokens (operator 4's tokenizer file); without a tokenizer ``pack``
counts words or takes a given length column.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.llm import bpe
from churnspark.llm._shared import row_key, staged, table, text_or_empty, words_of
from churnspark.operators.rows import positions

N_BUCKETS = 12
MULTIPLE = 8
TOKEN_BUDGET = 32_768


def word_length(text: Column) -> Column:
    """The default length: words of the text.  Any other length column can be given."""
    return F.size(words_of(text)).cast("long")


def best_buckets(lengths: list[int], counts: list[int], n_buckets: int) -> list[int]:
    """Bucket lengths (ascending, the longest included) of least total padding.

    best[k][j] = min over i < j of best[k-1][i] + pad(i, j), where pad(i, j) pads lengths i+1..j
    to length j.  The cost satisfies the quadrangle inequality, so the best i never falls as j
    grows, and each layer is solved by halving in O(d log d)."""
    if not lengths:
        return []
    order = np.argsort(lengths)
    ls, cs = np.asarray(lengths, dtype=np.float64)[order], np.asarray(counts, dtype=np.float64)[order]
    d = len(ls)
    docs = np.concatenate([[0], np.cumsum(cs)])
    toks = np.concatenate([[0], np.cumsum(cs * ls)])
    pad = lambda i, j: ls[j - 1] * (docs[j] - docs[i]) - (toks[j] - toks[i])
    layer = np.array([0.0] + [pad(0, j) for j in range(1, d + 1)])
    came = [np.zeros(d + 1, dtype=np.int64)]
    for _ in range(1, min(n_buckets, d)):
        new, via = np.full(d + 1, np.inf), np.zeros(d + 1, dtype=np.int64)
        new[0] = 0.0
        todo = [(1, d, 0, d - 1)]
        while todo:
            a, b, lo, hi = todo.pop()
            if a > b:
                continue
            j = (a + b) // 2
            i = np.arange(lo, min(hi, j - 1) + 1)
            cost = layer[i] + pad(i, j)
            k = int(np.argmin(cost))
            new[j], via[j] = cost[k], i[k]
            todo += [(a, j - 1, lo, int(i[k])), (j + 1, b, int(i[k]), hi)]
        came.append(via)
        layer = new
    out, j = [], d
    for via in reversed(came):
        if j == 0:
            break
        out.append(int(ls[j - 1]))
        j = int(via[j])
    return sorted(set(out))


def histogram(lengths: DataFrame, multiple: int = MULTIPLE) -> DataFrame:
    """(padded, n_docs): one row per padded length."""
    return lengths.groupBy("padded").agg(F.count(F.lit(1)).alias("n_docs"))


def padded(n: Column, multiple: int = MULTIPLE) -> Column:
    return F.greatest(F.ceil(n / multiple) * multiple, F.lit(multiple)).cast("long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None,
         n_buckets: int = N_BUCKETS, multiple: int = MULTIPLE, token_budget: int = TOKEN_BUDGET,
         tokenizer: str | None = None) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``bucket`` (its length), ``batch`` and
    ``slot`` (both from 0, inside the bucket) and ``padding``.  With the path of a ``tokenizer``
    file, lengths are encoded tokens."""
    key = row_key(id_col, text_col)
    if tokenizer is not None:
        texts = docs.select(F.struct(*key).alias("key"), text_or_empty(text_col).alias("t"))
        rows = bpe.encoded_lengths(texts, tokenizer, "key", "t").select("doc_id.id", "doc_id.th", "n_tokens")
    else:
        n = word_length(text_or_empty(text_col)) if length is None else F.coalesce(length.cast("long"), F.lit(0))
        rows = docs.select(*key, n.alias("n_tokens"))
    rows = staged(rows.withColumn("padded", padded(F.col("n_tokens"), multiple)), "lengths")
    hist = histogram(rows, multiple).collect()
    bounds = best_buckets([r.padded for r in hist], [r.n_docs for r in hist], n_buckets)
    if not bounds:
        bounds = [multiple]
    fits = F.lit(bounds[-1])
    for b in reversed(bounds[:-1]):
        fits = F.when(F.col("padded") <= b, F.lit(b)).otherwise(fits)
    rows = rows.withColumn("bucket", fits.cast("long")).drop("padded")
    at = positions(rows, ["id", "th"], ["bucket"], name="pos")
    cap = F.greatest(F.expr(f"{token_budget} div bucket"), F.lit(1))
    at = at.withColumn("cap", cap)
    return at.select(F.col("id").alias("doc_id"), "n_tokens", "bucket", F.expr("(pos - 1) div cap").alias("batch"),
                     F.expr("(pos - 1) % cap").cast("long").alias("slot"),
                     (F.col("bucket") - F.col("n_tokens")).alias("padding"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer=bpe.tokenizer_path())
