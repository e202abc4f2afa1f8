"""Operator 8: token counts from an exact length histogram.

Documents are aggregated by encoded length; suffix sums over the histogram then answer, for
every context limit, how many documents and tokens lie at or beyond it and how many tokens
remain when each document is cut at it.  Quantiles read the same table.

Null texts count as empty (length 0); equal lengths share a row; an empty table gives an
empty histogram.  The histogram has one row per distinct length, so it is bounded by the
longest document and not by their number; its sums are still taken in blocks of lengths, and
only the one-row-per-block table is summed in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from churnspark.llm import bpe
from churnspark.llm._shared import staged, table

BLOCK = 1024


def histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """(n_tokens, n_docs): pre-aggregated before the shuffle."""
    return (lengths.select(F.col(length_col).cast("long").alias("n_tokens")).groupBy("n_tokens")
                   .agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per distinct length L: ``docs_ge`` and ``tokens_ge`` of documents of at least L tokens,
    ``truncated_total`` (tokens left when every document is cut at L), ``total_tokens`` and
    ``share_le`` (share of documents of at most L tokens)."""
    # read for the rows and for the blocks: written once, or the texts would be encoded twice
    hist = staged(hist, "histogram")
    rows = hist.withColumn("block", F.expr(f"n_tokens div {BLOCK}")).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("docs_after"),
                           F.coalesce(F.sum("t").over(after), F.lit(0)).alias("tokens_after"),
                           F.sum("d").over(every).alias("docs"), F.sum("t").over(every).alias("total_tokens"))
    here = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(blocks, "block").select(
        "n_tokens", "n_docs", (F.sum("n_docs").over(here) + F.col("docs_after")).alias("docs_ge"),
        (F.sum("tokens").over(here) + F.col("tokens_after")).alias("tokens_ge"), "docs", "total_tokens")
    return out.select(
        "n_tokens", "n_docs", "docs_ge", "tokens_ge",
        (F.col("total_tokens") - F.col("tokens_ge") + F.col("n_tokens") * F.col("docs_ge")).alias("truncated_total"),
        "total_tokens",
        ((F.col("docs") - F.col("docs_ge") + F.col("n_docs")) / F.col("docs")).alias("share_le"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Answers for given context limits: the smallest length at or beyond each limit holds
    its suffix sums."""
    out = None
    for limit in limits:
        beyond = F.col("n_tokens") >= limit
        one = sums.agg(F.lit(limit).cast("long").alias("context_limit"), F.max("total_tokens").alias("total_tokens"),
                       F.coalesce(F.max(F.when(beyond, F.col("docs_ge"))), F.lit(0)).alias("docs_ge"),
                       F.coalesce(F.max(F.when(beyond, F.col("tokens_ge"))), F.lit(0)).alias("tokens_ge"))
        one = one.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_ge") + F.col("docs_ge") * limit)
        out = one if out is None else out.unionByName(one)
    return out


def quantiles(sums: DataFrame, probs: list[float]) -> DataFrame:
    """Smallest length that holds at least the given share of documents."""
    row = sums.agg(*[F.min(F.when(F.col("share_le") >= p, F.col("n_tokens"))).alias(f"q{k}") for k, p in enumerate(probs)])
    pairs = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.col(f"q{k}").alias("n_tokens")) for k, p in enumerate(probs)])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = bpe.encoded_lengths(table(spark, sf_dir, "documents"), bpe.tokenizer_path())
    return suffix_sums(histogram(lengths))
