"""Dashboard analytics as lazy DataFrame queries: KPIs, group-bys, shares, histograms,
box statistics, correlation, filter options, class balance and load summaries.

Every aggregate is algebraic (partial aggregation map-side), the exact quartiles included:
``rows.exact_quantiles`` selects them in a few counting passes, so no group is ever held by one
task.  Small derived tables (one stats row, k class rows, <= 100 bins) are
joined with an explicit broadcast only where their size is bounded by construction.
"""

from __future__ import annotations

from itertools import combinations_with_replacement
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.operators import rows as R


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


# -- D1: KPI row ---------------------------------------------------------------------

def kpi_overview(df: DataFrame, churn: str = "churn_value", cltv: str = "cltv",
                 tenure: str = "tenure_in_months") -> DataFrame:
    """customers, churn_rate_pct, avg_cltv, avg_tenure; rates and means are 0 when empty."""
    return df.agg(
        F.count(F.lit(1)).alias("customers"),
        F.coalesce(F.avg(_q(churn)) * 100.0, F.lit(0.0)).alias("churn_rate_pct"),
        F.coalesce(F.avg(_q(cltv)).cast("double"), F.lit(0.0)).alias("avg_cltv"),
        F.coalesce(F.avg(_q(tenure)).cast("double"), F.lit(0.0)).alias("avg_tenure"),
    )


# -- D2 / D3: churn rate by category -------------------------------------------------

def rate_by(df: DataFrame, category: str, churn: str = "churn_value", drop_null_keys: bool = True) -> DataFrame:
    src = df.filter(_q(category).isNotNull()) if drop_null_keys else df
    return src.groupBy(_q(category)).agg((F.avg(_q(churn)) * 100.0).alias("churn_rate_pct"))


# -- D4-D8: group-by of y by x -------------------------------------------------------

AGGREGATIONS = ("mean", "sum", "count", "min", "max")


def _agg_expr(y: str, how: str) -> Column:
    c = _q(y)
    if how == "mean":
        return F.avg(c)
    if how == "sum":
        # pandas gives 0 for a group of only NULLs; Spark gives NULL
        return F.coalesce(F.sum(c), F.lit(0))
    if how == "count":
        return F.count(c)
    if how == "min":
        return F.min(c)
    if how == "max":
        return F.max(c)
    raise ValueError(f"aggregation must be one of {AGGREGATIONS}")


def group_agg(df: DataFrame, x: str, y: str, how: str = "mean", drop_null_keys: bool = False,
              value_name: str = "value") -> DataFrame:
    """One row per x (NULL key kept unless ``drop_null_keys``); NULL y values skipped."""
    src = df.filter(_q(x).isNotNull()) if drop_null_keys else df
    return src.groupBy(_q(x)).agg(_agg_expr(y, how).alias(value_name))


def sorted_groups(df: DataFrame, x: str) -> DataFrame:
    """key order, NULL last (display order of the group-by charts)."""
    return df.orderBy(_q(x).asc_nulls_last())


# -- D9: share of total (pie) --------------------------------------------------------

def category_share(df: DataFrame, x: str, y: str, how: str = "sum", drop_null_keys: bool = False) -> DataFrame:
    g = group_agg(df, x, y, how, drop_null_keys)
    total = g.agg(F.sum("value").cast("double")).scalar()   # scalar subquery, one value
    return g.withColumn("share", F.try_divide(F.col("value").cast("double"), total))


# -- D10 / D11: histograms -----------------------------------------------------------

def histogram(df: DataFrame, x: str, bins: int = 30, group: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max] of the non-NULL x; the max falls in the last bin.
    Every bin is present (0 for empty ones), per group when ``group`` is given.
    Columns: [group], bin, bin_lo, bin_hi, count."""
    if not (1 <= bins <= 1000):
        raise ValueError("bins must be in 1..1000")
    gcols = [_q(group)] if group else []
    vals = df.select(*gcols, _q(x).cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    # one scalar subquery (a struct): min and bin width
    st = vals.agg(F.struct(F.min("_x").alias("lo"),
                           ((F.max("_x") - F.min("_x")) / F.lit(float(bins))).alias("w"))).scalar()
    lo, width = st.getField("lo"), st.getField("w")
    b = F.when(width > 0, F.least(F.floor((F.col("_x") - lo) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    counted = vals.withColumn("bin", b).groupBy(*gcols, "bin").agg(F.count(F.lit(1)).alias("count"))
    all_bins = F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")
    if group:
        # every (group, bin): each group that has a value (read off the small count table,
        # not the data) exploded into the fixed bin list
        frame = counted.select(_q(group)).distinct().select(_q(group), all_bins).alias("_f")
        cnt = counted.alias("_c")
        cond = F.col(f"_f.`{group}`").eqNullSafe(F.col(f"_c.`{group}`")) & (F.col("_f.bin") == F.col("_c.bin"))
        joined = frame.join(cnt, on=cond, how="left").select(F.col(f"_f.`{group}`").alias(group),
                                                             F.col("_f.bin").alias("bin"), F.col("_c.count"))
    else:
        # no values, no minimum, no bins
        frame = df.sparkSession.range(1).filter(lo.isNotNull()).select(all_bins)
        joined = frame.join(counted, on="bin", how="left")
    return joined.select(
        *gcols,
        F.col("bin"),
        (lo + F.col("bin") * width).alias("bin_lo"),
        (lo + (F.col("bin") + 1) * width).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


# -- D12 / D13: box statistics and outliers ------------------------------------------

def _with_fences(df: DataFrame, fences: DataFrame, group: str | None) -> DataFrame:
    """``df`` with the lower_fence and upper_fence of its group (rows of other groups go)."""
    if group:
        # one row per group, size-checked before the broadcast
        f = R.broadcast_if_small(fences.select(_q(group).alias("_g"), "lower_fence", "upper_fence"))
        return df.join(f, on=df[group].eqNullSafe(f["_g"]), how="inner").drop("_g")
    fs = fences.select(F.struct("lower_fence", "upper_fence")).scalar()
    return df.withColumns({"lower_fence": fs.getField("lower_fence"), "upper_fence": fs.getField("upper_fence")})


def box_stats(df: DataFrame, y: str, group: str | None = None) -> DataFrame:
    """Quartiles (linear interpolation), IQR, 1.5 IQR fences, whiskers (most extreme values
    inside the fences), outlier count, min and max, per group (NULL group kept; no row for a
    group, or a frame, without values).

    One algorithm for every size: quartiles by exact selection, the rest in one more pass over
    (group, value); no value is shuffled."""
    gcols = [group] if group else []
    q = R.exact_quantiles(df, y, [0.25, 0.5, 0.75], gcols, ["q1", "median", "q3"])
    fences = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
               .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr"))
               .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr")))
    yv, lo, hi = F.col("_y"), F.col("lower_fence"), F.col("upper_fence")
    aggs = [F.min(F.when(yv >= lo, yv)).alias("whisker_low"), F.max(F.when(yv <= hi, yv)).alias("whisker_high"),
            F.sum(F.when((yv < lo) | (yv > hi), F.lit(1)).otherwise(F.lit(0))).alias("n_outliers"),
            F.min(yv).alias("min"), F.max(yv).alias("max")]
    values = df.select(*[_q(c) for c in gcols], _q(y).cast("double").alias("_y")).filter("_y IS NOT NULL")
    fenced = _with_fences(values, fences, group)
    if group:
        w = fenced.groupBy(_q(group).alias("_g")).agg(*aggs)
        out = fences.join(w, on=fences[group].eqNullSafe(w["_g"]), how="inner").drop("_g")
    else:
        ws = fenced.agg(F.struct(*aggs)).scalar()
        out = fences.select("*", ws.alias("_w")).select(*fences.columns, "_w.*")
    return out.select(*[_q(c) for c in gcols], "n", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence",
                      "whisker_low", "whisker_high", "n_outliers", "min", "max")


def box_outliers(df: DataFrame, y: str, group: str | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Rows whose y lies outside the 1.5 IQR fences of their group."""
    stats = stats if stats is not None else box_stats(df, y, group)
    yv = _q(y).cast("double")
    joined = _with_fences(df, stats, group)
    return joined.filter((yv < F.col("lower_fence")) | (yv > F.col("upper_fence"))).drop("lower_fence", "upper_fence")


# -- D14: correlation matrix ---------------------------------------------------------

def corr_matrix(df: DataFrame, cols: Sequence[str], chunk: int = 64) -> DataFrame:
    """Pearson correlation for every ordered pair (a, b) of ``cols`` over the rows where
    both are non-NULL; NULL where a variance is 0 (never raises).  Long form (a, b, r).
    One pass over the data per ``chunk`` column pairs."""
    cols = list(cols)
    if len(cols) < 2:
        raise ValueError("a correlation matrix needs at least two numeric columns")
    pairs = list(combinations_with_replacement(range(len(cols)), 2))
    parts = []
    for start in range(0, len(pairs), chunk):
        block = pairs[start:start + chunk]
        aggs = []
        for k, (i, j) in enumerate(block):
            a, b = _q(cols[i]).cast("double"), _q(cols[j]).cast("double")
            both = a.isNotNull() & b.isNotNull()
            aggs += [F.covar_pop(F.when(both, a), F.when(both, b)).alias(f"c{k}"),
                     F.var_pop(F.when(both, a)).alias(f"va{k}"),
                     F.var_pop(F.when(both, b)).alias(f"vb{k}")]
        row = df.agg(*aggs)
        entries = []
        for k, (i, j) in enumerate(block):
            r = F.try_divide(F.col(f"c{k}"), F.sqrt(F.col(f"va{k}") * F.col(f"vb{k}")))
            r = F.when(F.col(f"va{k}") * F.col(f"vb{k}") > 0, F.least(F.greatest(r, F.lit(-1.0)), F.lit(1.0)))
            entries.append(F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), r.alias("r")))
            if i != j:
                entries.append(F.struct(F.lit(cols[j]).alias("a"), F.lit(cols[i]).alias("b"), r.alias("r")))
        parts.append(row.select(F.inline(F.array(*entries))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- D15: filter options -------------------------------------------------------------

def filter_options(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct non-NULL values of each column as (column, value), sorted."""
    cols = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), _q(c).cast("string").alias("value")) for c in cols])
    return (df.select(F.inline(pairs)).filter(F.col("value").isNotNull())
              .distinct().orderBy("column", "value"))


# -- D16 / D20: class weights and balance --------------------------------------------

def class_counts(df: DataFrame, label: str) -> DataFrame:
    c = df.groupBy(_q(label)).agg(F.count(F.lit(1)).alias("n_class"))
    t = c.agg(F.struct(F.sum("n_class").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return c.withColumns({"n_total": t.getField("n"), "n_classes": t.getField("k")})


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k * n_c) per class (the scikit-learn "balanced" rule)."""
    return class_counts(df, label).select(
        _q(label), "n_class",
        (F.col("n_total") / (F.col("n_classes") * F.col("n_class"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    w = class_weights(df, label).select(_q(label), F.col("weight").alias(name))
    return df.join(R.broadcast_if_small(w), on=label, how="left")


def class_balance(df: DataFrame, label: str) -> DataFrame:
    return class_counts(df, label).select(
        _q(label), "n_class", (F.col("n_class") * 100.0 / F.col("n_total")).alias("share_pct"))


# -- D17 / D18: counts and load summaries --------------------------------------------

def version_counts(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_cols", F.lit(len(df.columns)))


def load_summary(statuses: DataFrame, status: str = "status") -> DataFrame:
    return statuses.groupBy(_q(status)).agg(F.count(F.lit(1)).alias("n"))
