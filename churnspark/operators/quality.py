"""Data-quality checks as DataFrame operators: per-row status, dependency rules,
domain / range / length violations.  Narrow (per-row) predicates plus one small
aggregation for the counts."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark.functions import scalars as X


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def row_status(df: DataFrame, required: Sequence[str], status: str = "status", error: str = "error") -> DataFrame:
    """Per-row status instead of a failed job: "Error" with the list of missing required
    values, else "OK".  Checks are schema-driven and run inside the scan's stage."""
    missing = F.concat_ws(", ", *[F.when(_q(c).isNull(), F.lit(c)) for c in required])
    return (df.withColumn(error, F.when(missing != "", F.concat(F.lit("missing required value: "), missing)))
              .withColumn(status, F.when(F.col(error).isNull(), F.lit("OK")).otherwise(F.lit("Error"))))


def dependency_violations(df: DataFrame, key: str, rules: Mapping[str, Sequence[str]]) -> DataFrame:
    """(key, base, extra) for every extra service that is not "No" while its base is "No"."""
    checks = [F.struct(F.lit(b).alias("base"), F.lit(e).alias("extra"),
                       X.breaks_dependency(_q(b), _q(e)).alias("_bad"))
              for b, extras in rules.items() for e in extras]
    return df.select(_q(key), F.inline(F.array(*checks))).filter("_bad").drop("_bad")


def domain_violations(df: DataFrame, domains: Mapping[str, list] | None = None,
                      ranges: Mapping[str, tuple] | None = None,
                      lengths: Mapping[str, int] | None = None) -> DataFrame:
    """(column, rule, n_violations) for each rule broken at least once."""
    checks = []
    for c, allowed in (domains or {}).items():
        if c in df.columns:
            checks.append(F.struct(F.lit(c).alias("column"), F.lit("domain").alias("rule"),
                                   X.outside_domain(_q(c), allowed).alias("_bad")))
    for c, (lo, hi) in (ranges or {}).items():
        if c in df.columns:
            checks.append(F.struct(F.lit(c).alias("column"), F.lit("range").alias("rule"),
                                   X.outside_range(_q(c), lo, hi).alias("_bad")))
    for c, n in (lengths or {}).items():
        if c in df.columns:
            checks.append(F.struct(F.lit(c).alias("column"), F.lit("length").alias("rule"),
                                   X.too_long(_q(c), n).alias("_bad")))
    if not checks:
        raise ValueError("no applicable checks")
    return (df.select(F.inline(F.array(*checks))).filter("_bad")
              .groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n_violations")))
