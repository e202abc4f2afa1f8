"""§3.4 dashboard overview: one filter, five panels.

The filtered frame is persisted once and shared by every panel (the common subplan of
the source system's overview), each panel is a lazy DataFrame, and ``release`` drops the
cache when the caller is done.  Column names are those of the customers table; the
driver-table query maps its stand-in columns onto them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark.operators import analytics as A
from churnspark.operators import clean as C
from churnspark.operators import rows as R

# panel columns of the overview (table column names)
PANEL_COLUMNS = {"contract": "contract", "internet": "internet_service", "tenure": "tenure_in_months",
                 "label": "churn_label", "monthly": "monthly_charge", "churn": "churn_value", "cltv": "cltv"}


@dataclass
class Overview:
    filtered: DataFrame
    kpis: DataFrame
    rate_by_contract: DataFrame
    rate_by_internet: DataFrame
    tenure_histogram: DataFrame
    monthly_box: DataFrame
    columns: dict = field(default_factory=dict)

    def release(self) -> None:
        self.filtered.unpersist(blocking=False)

    def long_form(self) -> DataFrame:
        """All panels as (panel, label, value) rows, e.g. for export or comparison."""
        c = self.columns
        parts = [
            self.kpis.select(F.inline(F.array(*[F.struct(F.lit("kpi").alias("panel"), F.lit(k).alias("label"),
                                                         F.col(k).cast("double").alias("value"))
                                              for k in ("customers", "churn_rate_pct", "avg_cltv", "avg_tenure")]))),
            self.rate_by_contract.select(F.lit("rate_by_contract").alias("panel"),
                                         F.col(c["contract"]).cast("string").alias("label"),
                                         F.col("churn_rate_pct").alias("value")),
            self.rate_by_internet.select(F.lit("rate_by_internet").alias("panel"),
                                         F.col(c["internet"]).cast("string").alias("label"),
                                         F.col("churn_rate_pct").alias("value")),
            self.tenure_histogram.select(F.lit("tenure_histogram").alias("panel"),
                                         F.concat_ws("|", F.col(c["label"]).cast("string"),
                                                     F.col("bin").cast("string")).alias("label"),
                                         F.col("count").cast("double").alias("value")),
            self.monthly_box.select(F.lit("monthly_box").alias("panel"),
                                    F.coalesce(F.col(c["label"]).cast("string"), F.lit("")).alias("label"),
                                    F.col("median").alias("value")),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out


def overview(df: DataFrame, selections: Mapping[str, list | None] | None = None,
             columns: Mapping[str, str] | None = None, bins: int = 30) -> Overview:
    """KPI row, churn rate by contract and by internet service (NULL keys dropped), tenure
    histogram split by churn label (shared edges) and monthly-charge box by churn label,
    all over one persisted filtered frame."""
    c = dict(PANEL_COLUMNS, **(columns or {}))
    # freed by release(), or with all other cached tables by rows.release_caches()
    filtered = R._keep(C.filter_in(df, selections or {}))
    return Overview(
        filtered=filtered,
        kpis=A.kpi_overview(filtered, churn=c["churn"], cltv=c["cltv"], tenure=c["tenure"]),
        rate_by_contract=A.rate_by(filtered, c["contract"], c["churn"]),
        rate_by_internet=A.rate_by(filtered, c["internet"], c["churn"]),
        tenure_histogram=A.histogram(filtered, c["tenure"], bins, group=c["label"]),
        monthly_box=A.box_stats(filtered, c["monthly"], c["label"]),
        columns=c,
    )
