"""Scoring frames (batch, row status, what-if) - the model-independent parts.

See ``churnspark.ml.model`` for the MLlib pipeline that produces probabilities."""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S


def whatif_grid(base: DataFrame, scenarios: Mapping[str, Sequence], defaults: Mapping[str, str] | None = None) -> DataFrame:
    """Every base row once per scenario value; services the form does not ask for are
    set to their fixed defaults.  Each row is expanded by ``explode`` of a literal array
    (a fixed, small list), so the grid is a narrow operation with no join."""
    defaults = S.WHATIF_DEFAULTS if defaults is None else defaults
    out = base
    for col, values in scenarios.items():
        out = out.withColumn(col, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.withColumns({k: F.lit(v) for k, v in defaults.items()})
