"""Column-level rules (all built-in expressions: JVM-side, whole-stage codegen, no UDFs).

Each function takes and returns a ``Column``; they never trigger an action.  ANSI mode is
on in Spark 4, so every conversion of untrusted text goes through ``try_cast`` /
``try_divide`` and never raises at run time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from churnspark import schema as S


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- H1 / H4: text -> number ---------------------------------------------------------

def to_double(c, default: float | None = 0.0) -> Column:
    """Text or number -> double; unparsable or NULL -> ``default`` (None keeps NULL)."""
    v = _c(c).try_cast("double")
    return v if default is None else F.coalesce(v, F.lit(float(default)))


def to_int_target(c) -> Column:
    """Target column -> 0/1 int: parse as number, truncate, NULL or bad -> 0."""
    return F.coalesce(_c(c).try_cast("double").try_cast("int"), F.lit(0))


# -- H2: number -> text --------------------------------------------------------------

def to_text(c) -> Column:
    return _c(c).cast("string")


# -- H3: label -> 0/1 ----------------------------------------------------------------

def label_to_int(c) -> Column:
    """``" YES "`` -> 1, ``"No"`` -> 0, NULL -> 0 (trim, lower, compare with "yes")."""
    return F.coalesce((F.lower(F.trim(_c(c))) == F.lit("yes")).cast("int"), F.lit(0))


# -- H5: blank -> NULL ---------------------------------------------------------------

def blank_to_null(c) -> Column:
    return F.nullif(_c(c), F.lit(""))


# -- H6 / H7 / H8: risk band, yes/no, rounding ----------------------------------------

def round_prob(c, digits: int = 4) -> Column:
    """Half-up rounding of a probability (the same rule in every scoring path)."""
    return F.round(_c(c), digits)


def risk_band(rounded_prob) -> Column:
    p = _c(rounded_prob)
    return (F.when(p >= F.lit(S.RISK_HIGH), F.lit("High"))
            .when(p >= F.lit(S.RISK_MEDIUM), F.lit("Medium"))
            .otherwise(F.lit("Low")))


def yes_no(c) -> Column:
    return F.when(_c(c), F.lit("Yes")).otherwise(F.lit("No"))


# -- H9: display formats -------------------------------------------------------------

def fmt_count(c) -> Column:
    """``1234`` -> ``"1,234"``."""
    return F.format_number(_c(c), 0)


def fmt_percent1(c) -> Column:
    """``12.345`` -> ``"12.3%"`` (half-up at one digit, no grouping)."""
    return F.concat(F.format_string("%.1f", F.round(_c(c), 1)), F.lit("%"))


def fmt_fixed1(c) -> Column:
    return F.format_string("%.1f", F.round(_c(c), 1))


# -- H10: outcome shown for a scored row ---------------------------------------------

def display_percent(*prob_candidates) -> Column:
    """First present probability; a value <= 1 is a fraction and is shown as percent."""
    v = F.coalesce(*[_c(c).try_cast("double") for c in prob_candidates])
    return F.when(v <= 1.0, v * 100.0).otherwise(v)


def display_outcome(label, pct) -> Column:
    """Churn flag: an explicit label wins, else percent >= 50; no number -> False."""
    lab = _c(label).cast("string")
    yes = lab.isin("true", "Yes", "1")
    no = lab.isin("false", "No", "0")
    p = _c(pct)
    return (F.when(yes, F.lit(True)).when(no, F.lit(False))
            .otherwise(F.coalesce(p >= 50.0, F.lit(False))))


# -- H11: NaN -> NULL ----------------------------------------------------------------

def nan_to_null(c) -> Column:
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


# -- H12: version and time strings ---------------------------------------------------

def model_version_of(ts) -> Column:
    return F.date_format(_c(ts), "'v'yyyyMMdd-HHmmss")


def iso_utc(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def snapshot_time(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd HH:mm:ss")


# -- H13: default ids ----------------------------------------------------------------

def default_row_id(id_col, row_number) -> Column:
    return F.coalesce(_c(id_col).cast("string"), F.concat(F.lit("ROW_"), _c(row_number).cast("string")))


# -- H14: derived flags --------------------------------------------------------------

def under_30(age) -> Column:
    return F.when(_c(age) < 30, F.lit("Yes")).when(_c(age).isNotNull(), F.lit("No"))


def senior(age) -> Column:
    return F.when(_c(age) >= 65, F.lit("Yes")).when(_c(age).isNotNull(), F.lit("No"))


def customer_status(churned, tenure) -> Column:
    return (F.when(_c(churned) == 1, F.lit("Churned"))
            .when(_c(tenure) <= 3, F.lit("Joined"))
            .otherwise(F.lit("Stayed")))


# -- H15: dependent-service rule -----------------------------------------------------

def breaks_dependency(base, extra) -> Column:
    """An extra service other than "No" while its base service is "No"."""
    return (_c(base) == F.lit("No")) & (F.coalesce(_c(extra), F.lit("No")) != F.lit("No"))


# -- H16 / H17: domains, ranges, lengths ---------------------------------------------

def outside_domain(c, allowed: list) -> Column:
    """Non-NULL value not in the allowed list."""
    return _c(c).isNotNull() & ~_c(c).isin(allowed)


def outside_range(c, lo, hi) -> Column:
    v = _c(c).try_cast("double")
    return v.isNotNull() & ((v < F.lit(lo)) | (v > F.lit(hi)))


def too_long(c, n: int) -> Column:
    return F.coalesce(F.length(_c(c)) > F.lit(n), F.lit(False))


# -- H18: "lat, lng" text ------------------------------------------------------------

def compose_pair(a, b) -> Column:
    return F.concat_ws(", ", _c(a).cast("string"), _c(b).cast("string"))


def split_pair(c) -> tuple[Column, Column]:
    parts = F.split(F.regexp_replace(_c(c), '"', ""), ",")
    return (F.trim(F.get(parts, 0)).try_cast("double"),
            F.trim(F.get(parts, 1)).try_cast("double"))
