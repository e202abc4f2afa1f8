"""Projection, rename, predicates and cleaning (narrow operators: no shuffle)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.functions import scalars as X


class MissingColumnsError(ValueError):
    def __init__(self, missing: list[str], required: list[str] | None = None):
        self.missing = missing
        self.required = required
        super().__init__(f"missing expected columns: {missing}")


# -- B1: rename by map and prune -----------------------------------------------------

def rename_prune(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep exactly the mapped columns, renamed, in map order."""
    require_columns(df, list(mapping))
    return df.select([F.col(f"`{a}`").alias(b) for a, b in mapping.items()])


# -- B2: alias-tolerant feature names ------------------------------------------------

def apply_aliases(df: DataFrame, aliases: Mapping[str, str] = S.FEATURE_ALIASES) -> DataFrame:
    """Fold every alias into its canonical column: the canonical name first, then aliases
    in map order; the first non-NULL value wins.  Alias columns are dropped, so two aliases
    of one feature never produce duplicate columns."""
    present = set(df.columns)
    targets: dict[str, list[str]] = {}
    for alias, target in aliases.items():
        if alias in present:
            targets.setdefault(target, []).append(alias)
    if not targets:
        return df
    drop = {a for srcs in targets.values() for a in srcs}
    out = []
    for c in df.columns:
        if c in drop or c in targets:
            continue
        out.append(F.col(f"`{c}`"))
    for target, srcs in targets.items():
        cands = ([F.col(f"`{target}`")] if target in present else []) + [F.col(f"`{a}`") for a in srcs]
        out.append((F.coalesce(*cands) if len(cands) > 1 else cands[0]).alias(target))
    return df.select(out)


# -- B3: header normalisation --------------------------------------------------------

def normalise_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[normalise_header(c) for c in df.columns])


# -- B4: whitelist projection --------------------------------------------------------

def whitelist(df: DataFrame, fields: Iterable[str] = S.ALL_CUSTOMER_FIELDS, key: str = S.KEY) -> DataFrame:
    """Key plus the known fields present; unknown columns are ignored."""
    keep = [key] + [c for c in fields if c in df.columns and c != key]
    return df.select([F.col(f"`{c}`") for c in keep])


# -- B5: required-column check -------------------------------------------------------

def require_columns(df: DataFrame, required: Iterable[str]) -> None:
    """Schema-only check (no job): raise with the full missing list."""
    required = list(required)
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise MissingColumnsError(missing, required)


# -- B6: conjunctive multi-column IN filter ------------------------------------------

def filter_in(df: DataFrame, selections: Mapping[str, list | None]) -> DataFrame:
    """AND of ``col IN (values)``.  An empty or missing list is no filter for that column;
    with a list, NULL never matches.  Columns absent from ``df`` are skipped."""
    preds: list[Column] = [F.col(f"`{c}`").isin(list(v)) for c, v in selections.items()
                           if v and c in df.columns]
    if not preds:
        return df
    return df.filter(reduce(lambda a, b: a & b, preds))


# -- B7: key lookup ------------------------------------------------------------------

def lookup(df: DataFrame, key_value, key: str = S.KEY) -> DataFrame:
    return df.filter(F.col(key) == F.lit(key_value))


def lookup_keys(df: DataFrame, keys: DataFrame, key: str = S.KEY) -> tuple[DataFrame, DataFrame]:
    """Bulk lookup: (rows found, requested keys not found).  Semi/anti joins on the key;
    Spark broadcasts the key list only when its measured size is under the threshold."""
    found = df.join(keys.select(key).distinct(), on=key, how="left_semi")
    missing = keys.select(key).distinct().join(df.select(key), on=key, how="left_anti")
    return found, missing


# -- B8: drop rows with a NULL feature -----------------------------------------------

def dropna_any(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.na.drop(how="any", subset=subset)


# -- B9: missing-key rows ------------------------------------------------------------

def has_key(key: str = S.KEY) -> Column:
    return F.coalesce(F.trim(F.col(key)), F.lit("")) != F.lit("")


def split_rejects(df: DataFrame, key: str = S.KEY) -> tuple[DataFrame, DataFrame]:
    """(rows with a key, rows without).  Both sides are lazy filters of one scan."""
    return df.filter(has_key(key)), df.filter(~has_key(key))


# -- B10: numeric columns ------------------------------------------------------------

def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


# -- B11: scatter projection ---------------------------------------------------------

def scatter_points(df: DataFrame, x: str, y: str, color: str | None = None,
                   sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    cols = [x, y] + ([color] if color else [])
    out = df.select([F.col(f"`{c}`") for c in cols])
    if sample_fraction is not None and sample_fraction < 1.0:
        # display-only thinning, seeded so that reruns show the same points
        out = out.sample(fraction=sample_fraction, seed=seed)
    return out


# -- B12: rows that may be logged ----------------------------------------------------

def loggable(df: DataFrame, key: str = S.KEY) -> DataFrame:
    return df.filter(F.col(key).isNotNull() & (F.col(key).cast("string") != F.lit("")))


# -- H1 / H5 over frames -------------------------------------------------------------

def coerce_numeric(df: DataFrame, cols: Iterable[str], default: float | None = 0.0) -> DataFrame:
    return df.withColumns({c: X.to_double(F.col(f"`{c}`"), default) for c in cols if c in df.columns})


def blanks_to_null(df: DataFrame, cols: Iterable[str] | None = None) -> DataFrame:
    string_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    cols = string_cols if cols is None else [c for c in cols if c in string_cols]
    return df.withColumns({c: X.blank_to_null(F.col(f"`{c}`")) for c in cols})


def cast_to_schema(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """``try_cast`` every known column to its table type; unknown columns untouched."""
    return df.withColumns({c: F.col(f"`{c}`").try_cast(t) for c, t in types.items() if c in df.columns})
