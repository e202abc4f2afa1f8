"""Declarative chart specs -> plot-ready DataFrames.

A spec names a chart kind and its columns; ``run_chart`` dispatches to the analytics
operators and returns a lazy DataFrame.  Rendering is left to the caller.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.operators import analytics as A
from churnspark.operators import clean as C

#: The statistics of a box chart in its long form.
BOX_LONG = ("q1", "median", "q3", "whisker_low", "whisker_high", "n_outliers")
KINDS = ("bar", "line", "pie", "histogram", "box", "scatter", "heatmap")


@dataclass(frozen=True)
class ChartSpec:
    kind: str
    x: str | None = None
    y: str | None = None
    aggregation: str = "mean"          # bar / line / pie: mean | sum | count | min | max
    bins: int = 30                     # histogram: 5..100
    group: str | None = None           # histogram / box split
    color: str | None = None           # scatter colour
    columns: Sequence[str] = ()        # heatmap columns (>= 2 numeric)
    version: int | None = None         # data version the chart was created from

    def validate(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"chart kind must be one of {KINDS}")
        if self.kind in ("bar", "line", "pie") and (not self.x or not self.y):
            raise ValueError(f"{self.kind} needs x and y")
        if self.kind in ("bar", "line", "pie") and self.aggregation not in A.AGGREGATIONS:
            raise ValueError(f"aggregation must be one of {A.AGGREGATIONS}")
        if self.kind == "histogram" and (not self.x or not (5 <= self.bins <= 100)):
            raise ValueError("histogram needs x and 5 <= bins <= 100")
        if self.kind == "box" and not self.y:
            raise ValueError("box needs y")
        if self.kind == "scatter" and (not self.x or not self.y):
            raise ValueError("scatter needs x and y")
        if self.kind == "heatmap" and len(self.columns) < 2:
            raise ValueError("a heatmap needs at least two numeric columns")


def run_chart(df: DataFrame, spec: ChartSpec) -> DataFrame:
    spec.validate()
    if spec.kind in ("bar", "line"):
        return A.sorted_groups(A.group_agg(df, spec.x, spec.y, spec.aggregation), spec.x)
    if spec.kind == "pie":
        return A.category_share(df, spec.x, spec.y, spec.aggregation)
    if spec.kind == "histogram":
        return A.histogram(df, spec.x, spec.bins, spec.group)
    if spec.kind == "box":
        return A.box_stats(df, spec.y, spec.x or spec.group)
    if spec.kind == "scatter":
        return C.scatter_points(df, spec.x, spec.y, spec.color)
    numeric = set(C.numeric_columns(df))
    cols = [c for c in spec.columns if c in numeric]
    if len(cols) < 2:
        raise ValueError("a heatmap needs at least two numeric columns")
    return A.corr_matrix(df, cols)


def run_long(df: DataFrame, specs: Sequence[ChartSpec]) -> DataFrame:
    """Several specs as one long frame (chart, label, value) for export or comparison."""
    parts = []
    for i, s in enumerate(specs):
        out = run_chart(df, s)
        name = F.lit(f"{i}:{s.kind}")
        if s.kind in ("bar", "line"):
            parts.append(out.select(name.alias("chart"), F.col(s.x).cast("string").alias("label"),
                                    F.col("value").cast("double").alias("value")))
        elif s.kind == "pie":
            parts.append(out.select(name.alias("chart"), F.col(s.x).cast("string").alias("label"),
                                    F.col("share").alias("value")))
        elif s.kind == "histogram":
            lab = F.col("bin").cast("string") if not s.group else \
                F.concat_ws("|", F.col(s.group).cast("string"), F.col("bin").cast("string"))
            parts.append(out.select(name.alias("chart"), lab.alias("label"), F.col("count").cast("double").alias("value")))
        elif s.kind == "heatmap":
            parts.append(out.select(name.alias("chart"), F.concat_ws("|", "a", "b").alias("label"), F.col("r").alias("value")))
        elif s.kind == "box":
            group = s.x or s.group
            key = F.coalesce(F.col(f"`{group}`").cast("string"), F.lit("")) if group else F.lit("")
            pairs = F.array(*[F.struct(F.concat_ws("|", key, F.lit(c)).alias("label"),
                                       F.col(c).cast("double").alias("value")) for c in BOX_LONG])
            parts.append(out.select(name.alias("chart"), F.inline(pairs)))
        else:
            text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (s.x, s.color) if c]
            parts.append(out.select(name.alias("chart"), F.concat_ws("|", *text).alias("label"),
                                    F.col(f"`{s.y}`").cast("double").alias("value")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    return res
