"""Evaluation and feature statistics: confusion metrics, exact ROC AUC, z-scores,
category slots.  All single-pass aggregates or the distributed running sum; no score
list is ever collected."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.operators import rows as R


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


# -- M6: accuracy, precision, recall, F1 ---------------------------------------------

def binary_metrics(df: DataFrame, label: str, predicted: str, digits: int | None = 4) -> DataFrame:
    """One row: tp, fp, tn, fn, accuracy, precision, recall, f1; 0 on division by zero."""
    y, p = _q(label).cast("int") == 1, _q(predicted).cast("boolean")
    cells = df.agg(F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & p, 1)).alias("fp"),
                   F.count(F.when(~y & ~p, 1)).alias("tn"), F.count(F.when(y & ~p, 1)).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    prec, rec = _safe_ratio(tp, tp + fp), _safe_ratio(tp, tp + fn)
    vals = {"accuracy": _safe_ratio(tp + tn, tp + fp + tn + fn), "precision": prec, "recall": rec,
            "f1": _safe_ratio(2 * tp, 2 * tp + fp + fn)}
    r = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    return cells.select("tp", "fp", "tn", "fn", *[r(v).alias(k) for k, v in vals.items()])


# -- M7 / W4: exact ROC AUC with ties ------------------------------------------------

def roc_auc(df: DataFrame, label: str, score: str, digits: int | None = 4) -> DataFrame:
    """Mann-Whitney form with average ranks for ties: exact.  Rows are first reduced to
    one row per distinct score (map-side partial aggregation); the ranks come from the
    distributed running sum over those.  0.0 when only one class is present."""
    y = _q(label).cast("int") == 1
    g = (df.filter(_q(score).isNotNull())
           .groupBy(_q(score).cast("double").alias("_s"))
           .agg(F.count(F.when(y, 1)).alias("_pos"), F.count(F.when(~y, 1)).alias("_neg"))
           .withColumn("_c", F.col("_pos") + F.col("_neg")))
    ranked = R.running_sum(g, ["_s"], "_c", "_cum")
    # average rank of a tie block = rows before it + (block size + 1) / 2
    avg_rank = F.col("_cum") - F.col("_c") + (F.col("_c") + 1) / 2.0
    t = ranked.agg(F.sum(F.col("_pos") * avg_rank).alias("_rs"),
                   F.sum("_pos").cast("double").alias("_P"), F.sum("_neg").cast("double").alias("_N"))
    auc = F.when((F.col("_P") > 0) & (F.col("_N") > 0),
                 (F.col("_rs") - F.col("_P") * (F.col("_P") + 1) / 2.0) / (F.col("_P") * F.col("_N"))) \
           .otherwise(F.lit(0.0))
    return t.select((F.round(auc, digits) if digits is not None else auc).alias("roc_auc"))


# -- M1: standardisation (SQL form) --------------------------------------------------

def zscore(df: DataFrame, cols: Sequence[str], suffix: str = "_z", ddof: int = 0) -> DataFrame:
    """(x - mean) / std with population (ddof=0) or sample (ddof=1) std; NULL for a
    constant column.  Mean and std come from one scalar subquery."""
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    st = df.agg(F.struct(*[F.struct(F.avg(_q(c)).alias("m"), std(_q(c)).alias("s")).alias(f"c{i}")
                           for i, c in enumerate(cols)])).scalar()
    return df.withColumns({f"{c}{suffix}": F.try_divide(_q(c).cast("double") - st.getField(f"c{i}").getField("m"),
                                                        st.getField(f"c{i}").getField("s"))
                           for i, c in enumerate(cols)})


# -- M2: category slots (SQL form of the one-hot encoder) ----------------------------

def category_slots(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, slot, n_rows): the slot each known value takes in the one-hot
    vector - frequency descending, ties by value, like ``StringIndexer(frequencyDesc)``.
    NULL gets no slot (all-zero vector).  Slots come from distributed positions over the
    distinct-value table, so a high-cardinality column is never ranked in one task."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols])
    counts = (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
                .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n_rows")))
    ranked = R.positions(counts, [F.desc("n_rows"), F.asc("value")], ["column"], name="_slot")
    return ranked.withColumn("slot", (F.col("_slot") - 1).cast("int")).drop("_slot")
