"""Registered queries (driver contract) and their DuckDB oracle SQL.

Each query reads whole driver tables (or frames Spark derives from them, see
``standins``) and runs a churnspark operator.  Computed doubles are rounded to 6 digits
on both sides (4 where the operator itself rounds), every column is aliased to the same
name in Spark and SQL, and every limit has a total tie-break.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.functions import scalars as X
from churnspark.operators import analytics as A
from churnspark.operators import clean as C
from churnspark.operators import merge as M
from churnspark.operators import metrics as MT
from churnspark.operators import quality as Q
from churnspark.operators import rows as R
from churnspark.plans import charts as CH
from churnspark.plans import standins as SI

Q6 = 6


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, Q6)


def _t(spark, d, name):
    return SI.table(spark, d, name)


# ---------------------------------------------------------------------------
# shared SQL building blocks (DuckDB)
# ---------------------------------------------------------------------------
C360_SQL = """
loc AS (
  SELECT c.c_custkey AS customer_id, r.r_name AS country, n.n_name AS state, c.c_mktsegment AS segment
  FROM customer c LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
demo AS (
  SELECT customer_id, balance FROM (
    SELECT user_id * 20 AS customer_id, value AS balance,
           row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1),
svc AS (
  SELECT customer_id, contract, monthly_charge FROM (
    SELECT o_custkey AS customer_id, o_orderpriority AS contract, o_totalprice AS monthly_charge,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders) WHERE rn = 1),
st AS (
  SELECT o_custkey AS customer_id, round(sum(o_totalprice), 2) AS total_charges,
         count(*) AS n_orders,
         CASE WHEN max(o_orderdate) < TIMESTAMP '2001-01-01 00:00:00' THEN 1 ELSE 0 END AS churn_value
  FROM orders GROUP BY o_custkey),
c360 AS (
  SELECT * FROM loc FULL JOIN demo USING (customer_id) FULL JOIN svc USING (customer_id)
  FULL JOIN st USING (customer_id))
"""

REGISTRY_SQL = """
reg AS (SELECT c_custkey AS customer_id, c_name AS name, c_nationkey AS nationkey,
               c_acctbal AS balance, c_mktsegment AS segment
        FROM customer),
batch AS (SELECT user_id * 20 AS customer_id, value AS balance, event_type AS segment,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth,
                 row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth_last
          FROM events),
inc AS (SELECT customer_id, balance, segment FROM batch WHERE nth_last = 1),
inc_first AS (SELECT customer_id, balance, segment FROM batch WHERE nth = 1)
"""

UPSERT_SQL = """
ups AS (
  SELECT coalesce(reg.customer_id, inc.customer_id) AS customer_id, reg.name, reg.nationkey,
         CASE WHEN inc.customer_id IS NOT NULL THEN inc.balance ELSE reg.balance END AS balance,
         CASE WHEN inc.customer_id IS NOT NULL THEN inc.segment ELSE reg.segment END AS segment
  FROM reg FULL JOIN inc ON reg.customer_id = inc.customer_id)
"""

LOG_SQL = """
logs AS (
  SELECT event_id AS inference_id, CAST(user_id AS VARCHAR) AS customer_id,
         round(value / (value + 100.0), 4) AS churn_probability,
         round(value / (value + 100.0), 4) > 0.5 AS predicted_churn,
         'v1.0' AS model_version, ts AS created_at
  FROM events)
"""

SCORED_SQL = """
scored AS (
  SELECT l.doc_id, l.quality AS label, round(d.n_chars / (d.n_chars + 1500.0), 4) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)
"""

# Dirty text made from events (no row is dropped; every event gets one raw value).
DIRTY_SQL = """
dirty AS (
  SELECT event_id, event_type,
         CASE event_type
           WHEN 'click' THEN ' ' || CAST(user_id AS VARCHAR) || '.5 '
           WHEN 'view' THEN props
           WHEN 'error' THEN ''
           WHEN 'signup' THEN NULL
           ELSE CAST(user_id AS VARCHAR) || 'e1' END AS raw,
         CASE event_type
           WHEN 'click' THEN ' YES ' WHEN 'view' THEN 'No' WHEN 'error' THEN NULL
           WHEN 'signup' THEN 'yes' ELSE 'maybe' END AS raw_label,
         CASE event_type WHEN 'signup' THEN '' WHEN 'error' THEN NULL
           ELSE CAST(user_id AS VARCHAR) END AS raw_id
  FROM events)
"""


def _with(*blocks: str) -> str:
    return "WITH " + ",\n".join(b.strip() for b in blocks) + "\n"


def _dirty(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    et = F.col("event_type")
    uid = F.col("user_id").cast("string")
    raw = (F.when(et == "click", F.concat(F.lit(" "), uid, F.lit(".5 ")))
            .when(et == "view", F.col("props"))
            .when(et == "error", F.lit(""))
            .when(et == "signup", F.lit(None).cast("string"))
            .otherwise(F.concat(uid, F.lit("e1"))))
    raw_label = (F.when(et == "click", F.lit(" YES ")).when(et == "view", F.lit("No"))
                  .when(et == "error", F.lit(None).cast("string")).when(et == "signup", F.lit("yes"))
                  .otherwise(F.lit("maybe")))
    raw_id = (F.when(et == "signup", F.lit("")).when(et == "error", F.lit(None).cast("string"))
               .otherwise(uid))
    return e.select("event_id", "event_type", raw.alias("raw"), raw_label.alias("raw_label"), raw_id.alias("raw_id"))


# ---------------------------------------------------------------------------
# queries
# ---------------------------------------------------------------------------
QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


# -- J1 / D1 / D2 / D3 ----------------------------------------------------------------

@query("customer_360", _with(C360_SQL) + "SELECT * FROM c360")
def q_customer_360(spark, d):
    return SI.customer_360(spark, d)


KPI_FILTER = {"contract": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "segment": []}


@query("kpi_overview", _with(C360_SQL) + """
SELECT count(*) AS customers,
       round(coalesce(avg(churn_value) * 100.0, 0.0), 6) AS churn_rate_pct,
       round(coalesce(avg(total_charges), 0.0), 6) AS avg_cltv,
       round(coalesce(avg(n_orders), 0.0), 6) AS avg_tenure
FROM c360 WHERE contract IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""")
def q_kpi_overview(spark, d):
    f = C.filter_in(SI.customer_360(spark, d, columns=["contract", "total_charges", "n_orders", "churn_value"]), KPI_FILTER)
    k = A.kpi_overview(f, churn="churn_value", cltv="total_charges", tenure="n_orders")
    return k.select("customers", r6("churn_rate_pct").alias("churn_rate_pct"),
                    r6("avg_cltv").alias("avg_cltv"), r6("avg_tenure").alias("avg_tenure"))


@query("rate_by_category", _with(C360_SQL) + """
SELECT contract, round(avg(churn_value) * 100.0, 6) AS churn_rate_pct
FROM c360 WHERE contract IS NOT NULL GROUP BY contract""")
def q_rate_by_category(spark, d):
    out = A.rate_by(SI.customer_360(spark, d, columns=["contract", "churn_value"]), "contract")
    return out.select("contract", r6("churn_rate_pct").alias("churn_rate_pct"))


@query("rate_by_category_2", _with(C360_SQL) + """
SELECT segment, round(avg(churn_value) * 100.0, 6) AS churn_rate_pct
FROM c360 WHERE segment IS NOT NULL GROUP BY segment""")
def q_rate_by_category_2(spark, d):
    out = A.rate_by(SI.customer_360(spark, d, columns=["segment", "churn_value"]), "segment")
    return out.select("segment", r6("churn_rate_pct").alias("churn_rate_pct"))


# -- D4-D8 ------------------------------------------------------------------------------

_GROUP_SQL = {
    "mean": "round(avg(monthly_charge), 6)",
    "sum": "round(coalesce(sum(monthly_charge), 0), 2)",
    "count": "count(monthly_charge)",
    "min": "min(monthly_charge)",
    "max": "max(monthly_charge)",
}


def _group_query(how: str):
    def fn(spark, d):
        out = A.group_agg(SI.customer_360(spark, d, columns=["segment", "monthly_charge"]), "segment", "monthly_charge", how)
        v = r6("value") if how == "mean" else F.round("value", 2) if how == "sum" else F.col("value")
        return out.select("segment", v.alias("value"))
    return fn


for _how in ("mean", "sum", "count", "min", "max"):
    query(f"group_{_how}", _with(C360_SQL) + f"SELECT segment, {_GROUP_SQL[_how]} AS value FROM c360 GROUP BY segment")(
        _group_query(_how))


@query("category_share", _with(C360_SQL) + """
SELECT contract, round(coalesce(sum(total_charges), 0), 2) AS value,
       round(coalesce(sum(total_charges), 0) / sum(coalesce(sum(total_charges), 0)) OVER (), 6) AS share
FROM c360 GROUP BY contract""")
def q_category_share(spark, d):
    out = A.category_share(SI.customer_360(spark, d, columns=["contract", "total_charges"]), "contract", "total_charges", "sum")
    # sums of ~1e10 are compared in cents: double sums differ by summation order beyond that
    return out.select("contract", F.round("value", 2).alias("value"), r6("share").alias("share"))


# -- D10 / D11 --------------------------------------------------------------------------

def _hist_sql(src: str, x: str, bins: int, group: str | None) -> str:
    g = f"{group}, " if group else ""
    if group:
        frame = (f"(SELECT gs.{group}, b.bin FROM (SELECT DISTINCT {group} FROM v) gs, range(0, {bins}) b(bin)) fr "
                 f"LEFT JOIN c ON fr.{group} IS NOT DISTINCT FROM c.{group} AND fr.bin = c.bin")
        gsel, where = f"fr.{group}, ", ""
    else:
        frame = f"(SELECT b.bin FROM range(0, {bins}) b(bin)) fr LEFT JOIN c ON fr.bin = c.bin"
        gsel, where = "", "WHERE (SELECT count(*) FROM v) > 0"
    return f"""
v AS (SELECT {g}CAST({x} AS DOUBLE) AS x FROM {src} WHERE {x} IS NOT NULL),
s AS (SELECT min(x) AS lo, (max(x) - min(x)) / {float(bins)} AS w FROM v),
c AS (SELECT {g}CAST(CASE WHEN (SELECT w FROM s) > 0
                   THEN least(floor((x - (SELECT lo FROM s)) / (SELECT w FROM s)), {bins - 1})
                   ELSE 0 END AS INTEGER) AS bin, count(*) AS cnt
      FROM v GROUP BY ALL)
SELECT {gsel}CAST(fr.bin AS INTEGER) AS bin,
       round((SELECT lo FROM s) + fr.bin * (SELECT w FROM s), 6) AS bin_lo,
       round((SELECT lo FROM s) + (fr.bin + 1) * (SELECT w FROM s), 6) AS bin_hi,
       CAST(coalesce(c.cnt, 0) AS BIGINT) AS count
FROM {frame} {where}"""


def _hist_out(df: DataFrame, group: str | None) -> DataFrame:
    return df.select(*([group] if group else []), "bin", r6("bin_lo").alias("bin_lo"),
                     r6("bin_hi").alias("bin_hi"), "count")


@query("histogram_bins", "WITH " + _hist_sql("lineitem", "l_quantity", 30, None).strip())
def q_histogram_bins(spark, d):
    return _hist_out(A.histogram(_t(spark, d, "lineitem"), "l_quantity", 30), None)


@query("histogram_by_group", _with(C360_SQL) + ", " + _hist_sql("c360", "n_orders", 30, "churn_value").strip())
def q_histogram_by_group(spark, d):
    return _hist_out(A.histogram(SI.customer_360(spark, d, columns=["n_orders", "churn_value"]), "n_orders", 30, group="churn_value"), "churn_value")


# -- D12 / D13 --------------------------------------------------------------------------

BOX_SQL = """
q AS (SELECT l_returnflag, count(l_extendedprice) AS n,
             quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
             quantile_cont(l_extendedprice, 0.75) AS q3
      FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY l_returnflag),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
"""


@query("box_stats", _with(BOX_SQL) + """
SELECT f.l_returnflag, f.n, round(f.q1, 6) AS q1, round(f.median, 6) AS median, round(f.q3, 6) AS q3,
       round(f.iqr, 6) AS iqr, round(f.lower_fence, 6) AS lower_fence, round(f.upper_fence, 6) AS upper_fence,
       round(min(CASE WHEN l.l_extendedprice >= f.lower_fence THEN l.l_extendedprice END), 6) AS whisker_low,
       round(max(CASE WHEN l.l_extendedprice <= f.upper_fence THEN l.l_extendedprice END), 6) AS whisker_high,
       count(CASE WHEN l.l_extendedprice < f.lower_fence OR l.l_extendedprice > f.upper_fence THEN 1 END) AS n_outliers,
       round(min(l.l_extendedprice), 6) AS min, round(max(l.l_extendedprice), 6) AS max
FROM f JOIN lineitem l ON l.l_returnflag IS NOT DISTINCT FROM f.l_returnflag AND l.l_extendedprice IS NOT NULL
GROUP BY f.l_returnflag, f.n, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence""")
def q_box_stats(spark, d):
    b = A.box_stats(_t(spark, d, "lineitem"), "l_extendedprice", group="l_returnflag")
    dbl = ["q1", "median", "q3", "iqr", "lower_fence", "upper_fence", "whisker_low", "whisker_high", "min", "max"]
    return b.select("l_returnflag", "n", "n_outliers", *[r6(c).alias(c) for c in dbl])


# an earlier key of the same statistics: one algorithm serves every size now
query("box_stats_ranked", ORACLES["box_stats"])(q_box_stats)


@query("box_outliers", """
WITH q AS (SELECT lang, quantile_cont(n_chars::DOUBLE, 0.25) AS q1, quantile_cont(n_chars::DOUBLE, 0.75) AS q3
           FROM documents GROUP BY lang),
f AS (SELECT lang, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT d.doc_id, d.lang, d.n_chars FROM documents d JOIN f ON d.lang IS NOT DISTINCT FROM f.lang
WHERE d.n_chars < f.lower_fence OR d.n_chars > f.upper_fence""")
def q_box_outliers(spark, d):
    return A.box_outliers(_t(spark, d, "documents").select("doc_id", "lang", "n_chars"), "n_chars", group="lang")


# -- D14 --------------------------------------------------------------------------------

CORR_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql() -> str:
    parts = []
    for a in CORR_COLS:
        for b in CORR_COLS:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            va = f"var_pop({a}) FILTER (WHERE {both})"
            vb = f"var_pop({b}) FILTER (WHERE {both})"
            cv = f"covar_pop({a}, {b}) FILTER (WHERE {both})"
            r = f"CASE WHEN {va} * {vb} > 0 THEN greatest(-1.0, least(1.0, {cv} / sqrt({va} * {vb}))) END"
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, round({r}, 6) AS r FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@query("corr_matrix", _corr_sql())
def q_corr_matrix(spark, d):
    out = A.corr_matrix(_t(spark, d, "lineitem"), CORR_COLS)
    return out.select("a", "b", r6("r").alias("r"))


# -- D15 / B6 ---------------------------------------------------------------------------

OPTION_COLS = ["contract", "segment", "state"]


@query("filter_options", _with(C360_SQL) + "\nUNION ALL\n".join(
    f"SELECT DISTINCT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM c360 WHERE {c} IS NOT NULL"
    for c in OPTION_COLS))
def q_filter_options(spark, d):
    return A.filter_options(SI.customer_360(spark, d, columns=OPTION_COLS), OPTION_COLS)


MULTI_FILTER = {"contract": ["1-URGENT", "2-HIGH"], "segment": ["BUILDING", "MACHINERY", "HOUSEHOLD"], "state": []}


@query("filter_multi_in", _with(C360_SQL) + """
SELECT * FROM c360 WHERE contract IN ('1-URGENT', '2-HIGH') AND segment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')""")
def q_filter_multi_in(spark, d):
    return C.filter_in(SI.customer_360(spark, d), MULTI_FILTER)


# -- B7 ---------------------------------------------------------------------------------
# the key list: every customer id the inference log mentions (events.user_id)

@query("lookup_keys", """
SELECT k.customer_id, c.c_custkey IS NOT NULL AS found
FROM (SELECT DISTINCT user_id AS customer_id FROM events) k
LEFT JOIN (SELECT DISTINCT c_custkey FROM customer) c ON k.customer_id = c.c_custkey""")
def q_lookup_keys(spark, d):
    cust = _t(spark, d, "customer").withColumnRenamed("c_custkey", "customer_id")
    keys = _t(spark, d, "events").select(F.col("user_id").alias("customer_id"))
    found, missing = C.lookup_keys(cust, keys, "customer_id")
    return (found.select("customer_id", F.lit(True).alias("found"))
                 .unionByName(missing.select("customer_id", F.lit(False).alias("found"))))


# -- A4 / F1 / F2 -----------------------------------------------------------------------

@query("scan_ordered", "SELECT * FROM customer ORDER BY c_custkey")
def q_scan_ordered(spark, d):
    from churnspark.sources import readers as RD
    return RD.scan_ordered(_t(spark, d, "customer"), "c_custkey")


@query("page_limit_offset", "SELECT * FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 100")
def q_page_limit_offset(spark, d):
    from churnspark.sources import readers as RD
    return RD.page(_t(spark, d, "customer"), "c_custkey", limit=50, offset=100)


@query("recent_logs", _with(LOG_SQL) + """
SELECT inference_id, customer_id, churn_probability, predicted_churn, model_version, created_at
FROM logs ORDER BY created_at DESC, inference_id DESC LIMIT 200""")
def q_recent_logs(spark, d):
    from churnspark.sources import readers as RD
    return RD.recent_logs(SI.inference_log(spark, d), limit=200)


# -- B1 / B2 / H2 -----------------------------------------------------------------------

RENAME = {"c_custkey": "customer_id", "c_name": "name", "c_acctbal": "balance", "c_mktsegment": "segment"}


@query("rename_prune", """
SELECT c_custkey AS customer_id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer""")
def q_rename_prune(spark, d):
    return C.rename_prune(_t(spark, d, "customer"), RENAME)


@query("feature_alias", """
SELECT c_custkey AS customer_id,
       coalesce(CASE WHEN c_acctbal >= 0 THEN c_nationkey END, c_nationkey + 100) AS "Tenure Months",
       c_acctbal AS "Monthly Charges", c_mktsegment AS "Gender"
FROM customer""")
def q_feature_alias(spark, d):
    c = _t(spark, d, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("tenure_in_months"),
        (F.col("c_nationkey") + 100).alias("tenure_months"),
        F.col("c_acctbal").alias("monthly_charge"),
        F.col("c_mktsegment").alias("gender"))
    return C.apply_aliases(c)


@query("cast_text", """
SELECT c_custkey AS customer_id, CAST(c_custkey * 7 + 90000 AS VARCHAR) AS zip_code FROM customer""")
def q_cast_text(spark, d):
    c = _t(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("customer_id"), X.to_text(F.col("c_custkey") * 7 + 90000).alias("zip_code"))


# -- H1 / H4 / H5 / H3 / H11 ------------------------------------------------------------

@query("coerce_numeric", _with(DIRTY_SQL) + """
SELECT event_id, raw, coalesce(TRY_CAST(raw AS DOUBLE), 0.0) AS num,
       coalesce(TRY_CAST(trunc(TRY_CAST(raw AS DOUBLE)) AS INTEGER), 0) AS target
FROM dirty""")
def q_coerce_numeric(spark, d):
    x = _dirty(spark, d)
    return x.select("event_id", "raw", X.to_double("raw").alias("num"), X.to_int_target("raw").alias("target"))


@query("blank_to_null", _with(DIRTY_SQL) + "SELECT event_id, raw, nullif(raw, '') AS cleaned FROM dirty")
def q_blank_to_null(spark, d):
    x = _dirty(spark, d)
    return x.select("event_id", "raw", X.blank_to_null("raw").alias("cleaned"))


@query("label_to_int", _with(DIRTY_SQL) + """
SELECT event_id, raw_label, coalesce(CAST(lower(trim(raw_label)) = 'yes' AS INTEGER), 0) AS churn_value FROM dirty""")
def q_label_to_int(spark, d):
    x = _dirty(spark, d)
    return x.select("event_id", "raw_label", X.label_to_int("raw_label").alias("churn_value"))


@query("nan_to_null", """
SELECT event_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS value
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN CAST('NaN' AS DOUBLE) ELSE value END AS x FROM events)""")
def q_nan_to_null(spark, d):
    e = _t(spark, d, "events")
    x = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", X.nan_to_null(x).alias("value"))


# -- B8 ---------------------------------------------------------------------------------

@query("dropna_any", _with(C360_SQL) + """
SELECT * FROM c360 WHERE country IS NOT NULL AND state IS NOT NULL AND segment IS NOT NULL
  AND balance IS NOT NULL AND contract IS NOT NULL AND monthly_charge IS NOT NULL
  AND total_charges IS NOT NULL AND n_orders IS NOT NULL AND churn_value IS NOT NULL""")
def q_dropna_any(spark, d):
    return C.dropna_any(SI.customer_360(spark, d))


# -- B9 / B12 / M10 / D18 ---------------------------------------------------------------

@query("reject_rows", _with(DIRTY_SQL) + """
SELECT file_row, event_id, raw_id, 'customer_id is required' AS error FROM (
  SELECT *, row_number() OVER (ORDER BY event_id) + 1 AS file_row FROM dirty)
WHERE coalesce(trim(raw_id), '') = ''""")
def q_reject_rows(spark, d):
    x = R.row_ids(_dirty(spark, d), ["event_id"], name="_rid")
    _, rejects = C.split_rejects(x, "raw_id")
    return rejects.select((F.col("_rid") + 1).alias("file_row"), "event_id", "raw_id",
                          F.lit("customer_id is required").alias("error"))


@query("loggable_rows", _with(DIRTY_SQL) + """
SELECT event_id, raw_id AS customer_id FROM dirty WHERE raw_id IS NOT NULL AND raw_id <> ''""")
def q_loggable_rows(spark, d):
    x = _dirty(spark, d).select("event_id", F.col("raw_id").alias("customer_id"))
    return C.loggable(x, "customer_id")


@query("score_status", _with(DIRTY_SQL) + """
SELECT event_id, raw_id AS customer_id, nullif(raw, '') AS feature,
       CASE WHEN raw_id IS NULL OR nullif(raw, '') IS NULL THEN 'missing required value: ' ||
         concat_ws(', ', CASE WHEN raw_id IS NULL THEN 'customer_id' END,
                         CASE WHEN nullif(raw, '') IS NULL THEN 'feature' END) END AS error,
       CASE WHEN raw_id IS NULL OR nullif(raw, '') IS NULL THEN 'Error' ELSE 'OK' END AS status
FROM dirty""")
def q_score_status(spark, d):
    x = _dirty(spark, d).select("event_id", F.col("raw_id").alias("customer_id"),
                                X.blank_to_null("raw").alias("feature"))
    return Q.row_status(x, ["customer_id", "feature"])


@query("load_summary", _with(DIRTY_SQL) + """
SELECT CASE WHEN coalesce(trim(raw_id), '') = '' THEN 'error' ELSE 'saved' END AS status, count(*) AS n
FROM dirty GROUP BY 1""")
def q_load_summary(spark, d):
    x = _dirty(spark, d).withColumn("status", F.when(C.has_key("raw_id"), "saved").otherwise("error"))
    return A.load_summary(x, "status")


# -- H6-H10 / H12 -----------------------------------------------------------------------

@query("risk_band", """
SELECT event_id, round(p, 4) AS churn_probability, p > 0.5 AS predicted_churn,
       CASE WHEN p > 0.5 THEN 'Yes' ELSE 'No' END AS prediction,
       CASE WHEN round(p, 4) >= 0.7 THEN 'High' WHEN round(p, 4) >= 0.4 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT event_id, value / (value + 100.0) AS p FROM events)""")
def q_risk_band(spark, d):
    p = F.col("value") / (F.col("value") + F.lit(100.0))
    e = _t(spark, d, "events").select("event_id", p.alias("p"))
    rp = X.round_prob("p")
    return e.select("event_id", rp.alias("churn_probability"), (F.col("p") > 0.5).alias("predicted_churn"),
                    X.yes_no(F.col("p") > 0.5).alias("prediction"), X.risk_band(rp).alias("risk_level"))


@query("display_outcome", """
SELECT event_id, round(pct, 6) AS display_pct,
       CASE WHEN pct IS NULL THEN 'N/A' ELSE printf('%.1f', round(pct, 1)) || '%' END AS prob_text,
       CASE WHEN lab IN ('true', 'Yes', '1') THEN true WHEN lab IN ('false', 'No', '0') THEN false
            ELSE coalesce(pct >= 50.0, false) END AS is_churn
FROM (SELECT event_id, lab,
             CASE WHEN v <= 1.0 THEN v * 100.0 ELSE v END AS pct
      FROM (SELECT event_id,
                   coalesce(CASE WHEN event_type = 'view' THEN NULL ELSE value / (value + 100.0) END,
                            CASE WHEN event_type = 'signup' THEN NULL ELSE value END) AS v,
                   CASE event_type WHEN 'click' THEN 'Yes' WHEN 'purchase' THEN 'No' END AS lab
            FROM events))""")
def q_display_outcome(spark, d):
    e = _t(spark, d, "events")
    et = F.col("event_type")
    prob = F.when(et == "view", F.lit(None).cast("double")).otherwise(F.col("value") / (F.col("value") + 100.0))
    raw = F.when(et == "signup", F.lit(None).cast("double")).otherwise(F.col("value"))
    lab = F.when(et == "click", "Yes").when(et == "purchase", "No")
    x = e.select("event_id", X.display_percent(prob, raw).alias("pct"), lab.alias("lab"))
    return x.select("event_id", r6("pct").alias("display_pct"),
                    F.when(F.col("pct").isNull(), F.lit("N/A")).otherwise(X.fmt_percent1("pct")).alias("prob_text"),
                    X.display_outcome("lab", "pct").alias("is_churn"))


@query("format_metrics", _with(C360_SQL) + """
SELECT format('{:,}', count(*)) AS customers_text,
       printf('%.1f', round(coalesce(avg(churn_value) * 100.0, 0.0), 1)) || '%' AS churn_rate_text,
       format('{:,}', CAST(round(coalesce(avg(total_charges), 0.0), 0) AS BIGINT)) AS avg_cltv_text,
       printf('%.1f', round(coalesce(avg(n_orders), 0.0), 1)) AS avg_tenure_text
FROM c360""")
def q_format_metrics(spark, d):
    k = A.kpi_overview(SI.customer_360(spark, d, columns=["total_charges", "n_orders", "churn_value"]), cltv="total_charges", tenure="n_orders")
    return k.select(X.fmt_count("customers").alias("customers_text"),
                    X.fmt_percent1("churn_rate_pct").alias("churn_rate_text"),
                    X.fmt_count(F.round("avg_cltv", 0)).alias("avg_cltv_text"),
                    X.fmt_fixed1("avg_tenure").alias("avg_tenure_text"))


@query("format_timestamps", """
SELECT event_id, strftime(ts, 'v%Y%m%d-%H%M%S') AS model_version,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS trained_at, strftime(ts, '%Y-%m-%d %H:%M:%S') AS snapshot_time
FROM events""")
def q_format_timestamps(spark, d):
    e = _t(spark, d, "events")
    return e.select("event_id", X.model_version_of("ts").alias("model_version"),
                    X.iso_utc("ts").alias("trained_at"), X.snapshot_time("ts").alias("snapshot_time"))


# -- H14 / H15 / H16 / H17 / H18 --------------------------------------------------------

@query("derived_flags", _with(C360_SQL) + """
SELECT customer_id, age,
       CASE WHEN age < 30 THEN 'Yes' WHEN age IS NOT NULL THEN 'No' END AS under_30,
       CASE WHEN age >= 65 THEN 'Yes' WHEN age IS NOT NULL THEN 'No' END AS senior_citizen,
       CASE WHEN churn_value = 1 THEN 'Churned' WHEN n_orders <= 3 THEN 'Joined' ELSE 'Stayed' END AS customer_status
FROM (SELECT *, CAST(floor(balance / 5.0) AS INTEGER) AS age FROM c360)""")
def q_derived_flags(spark, d):
    c = SI.customer_360(spark, d, columns=["balance", "n_orders", "churn_value"])
    c = c.withColumn("age", F.floor(F.col("balance") / 5.0).cast("int"))
    return c.select("customer_id", "age", X.under_30("age").alias("under_30"),
                    X.senior("age").alias("senior_citizen"),
                    X.customer_status("churn_value", "n_orders").alias("customer_status"))


PART_SERVICES_SQL = """
svcs AS (SELECT p_partkey,
                CASE WHEN p_type = 'SMALL' THEN 'No' ELSE 'Yes' END AS internet_service,
                CASE WHEN p_size > 25 THEN 'Yes' ELSE 'No' END AS online_security,
                CASE WHEN p_size > 45 THEN 'Yes' ELSE 'No' END AS streaming_tv,
                CASE WHEN p_retailprice > 1500 THEN 'Yes' ELSE 'No' END AS phone_service,
                CASE WHEN p_size > 40 THEN 'Yes' ELSE 'No' END AS multiple_lines
         FROM part)
"""


def _part_services(spark, d):
    p = _t(spark, d, "part")
    yn = lambda cond: F.when(cond, "Yes").otherwise("No")
    return p.select("p_partkey",
                    F.when(F.col("p_type") == "SMALL", "No").otherwise("Yes").alias("internet_service"),
                    yn(F.col("p_size") > 25).alias("online_security"),
                    yn(F.col("p_size") > 45).alias("streaming_tv"),
                    yn(F.col("p_retailprice") > 1500).alias("phone_service"),
                    yn(F.col("p_size") > 40).alias("multiple_lines"))


DEP_RULES = {"internet_service": ["online_security", "streaming_tv"], "phone_service": ["multiple_lines"]}


@query("dq_rules", _with(PART_SERVICES_SQL) + "\nUNION ALL\n".join(
    f"SELECT p_partkey, '{b}' AS base, '{e}' AS extra FROM svcs WHERE {b} = 'No' AND coalesce({e}, 'No') <> 'No'"
    for b, es in DEP_RULES.items() for e in es))
def q_dq_rules(spark, d):
    return Q.dependency_violations(_part_services(spark, d), "p_partkey", DEP_RULES)


DOMAINS = {"contract": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"]}
RANGES = {"monthly_charge": (0.0, 400000.0), "n_orders": (0, 20)}
LENGTHS = {"state": 10, "segment": 9}


@query("domain_violations", _with(C360_SQL) + """
SELECT "column", rule, count(*) AS n_violations FROM (
  SELECT 'contract' AS "column", 'domain' AS rule FROM c360
    WHERE contract IS NOT NULL AND contract NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
  UNION ALL SELECT 'monthly_charge', 'range' FROM c360
    WHERE monthly_charge IS NOT NULL AND (monthly_charge < 0.0 OR monthly_charge > 400000.0)
  UNION ALL SELECT 'n_orders', 'range' FROM c360
    WHERE n_orders IS NOT NULL AND (n_orders < 0 OR n_orders > 20)
  UNION ALL SELECT 'state', 'length' FROM c360 WHERE length(state) > 10
  UNION ALL SELECT 'segment', 'length' FROM c360 WHERE length(segment) > 9)
GROUP BY ALL""")
def q_domain_violations(spark, d):
    return Q.domain_violations(SI.customer_360(spark, d, columns=[*DOMAINS, *RANGES, *LENGTHS]), DOMAINS, RANGES, LENGTHS)


@query("compose_split_pair", """
SELECT s_suppkey, pair, TRY_CAST(trim(split_part(pair, ',', 1)) AS DOUBLE) AS lat,
       TRY_CAST(trim(split_part(pair, ',', 2)) AS DOUBLE) AS lng
FROM (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) || ', ' || CAST(s_suppkey AS VARCHAR) || '.25' AS pair FROM supplier)""")
def q_compose_split_pair(spark, d):
    s = _t(spark, d, "supplier")
    pair = X.compose_pair(F.col("s_nationkey"), F.concat(F.col("s_suppkey").cast("string"), F.lit(".25")))
    x = s.select("s_suppkey", pair.alias("pair"))
    lat, lng = X.split_pair("pair")
    return x.select("s_suppkey", "pair", lat.alias("lat"), lng.alias("lng"))


# -- D19 / J2-J5 / A12 / G1-G3 / D17 -----------------------------------------------------

@query("dedup_last", """
SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders) WHERE rn = 1""")
def q_dedup_last(spark, d):
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return M.dedup_last(o, "o_custkey", ["o_orderdate", "o_orderkey"])


@query("upsert_merge", _with(REGISTRY_SQL, UPSERT_SQL) + "SELECT * FROM ups")
def q_upsert_merge(spark, d):
    return M.upsert(SI.registry(spark, d), SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)


@query("update_merge", _with(REGISTRY_SQL) + """
SELECT reg.customer_id, reg.name, reg.nationkey,
       CASE WHEN inc.customer_id IS NOT NULL THEN inc.balance ELSE reg.balance END AS balance,
       CASE WHEN inc.customer_id IS NOT NULL THEN inc.segment ELSE reg.segment END AS segment
FROM reg LEFT JOIN inc ON reg.customer_id = inc.customer_id""")
def q_update_merge(spark, d):
    out, _ = M.update(SI.registry(spark, d), SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return out


@query("insert_ignore", _with(REGISTRY_SQL) + """
SELECT customer_id, name, nationkey, balance, segment FROM reg
UNION ALL
SELECT customer_id, NULL, NULL, balance, segment FROM inc_first
WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.customer_id = inc_first.customer_id)""")
def q_insert_ignore(spark, d):
    return M.insert_ignore(SI.registry(spark, d), SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)


@query("delete_keys", _with(REGISTRY_SQL) + """
SELECT * FROM reg WHERE NOT EXISTS (SELECT 1 FROM inc WHERE inc.customer_id = reg.customer_id)""")
def q_delete_keys(spark, d):
    out, _ = M.delete(SI.registry(spark, d), SI.incoming_batch(spark, d).select("customer_id"), "customer_id")
    return out


@query("added_rows", _with(REGISTRY_SQL, UPSERT_SQL) + """
SELECT * FROM ups WHERE NOT EXISTS (
  SELECT 1 FROM reg WHERE reg.customer_id IS NOT DISTINCT FROM ups.customer_id
    AND reg.name IS NOT DISTINCT FROM ups.name AND reg.nationkey IS NOT DISTINCT FROM ups.nationkey
    AND reg.balance IS NOT DISTINCT FROM ups.balance AND reg.segment IS NOT DISTINCT FROM ups.segment)""")
def q_added_rows(spark, d):
    v1 = SI.registry(spark, d)
    v2 = M.upsert(v1, SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return M.added_rows(v2, v1)


@query("except_all_rows", _with(REGISTRY_SQL, UPSERT_SQL) + """
SELECT * FROM reg EXCEPT ALL SELECT * FROM ups""")
def q_except_all_rows(spark, d):
    v1 = SI.registry(spark, d)
    v2 = M.upsert(v1, SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return M.except_all_rows(v1, v2)


@query("version_counts", _with(REGISTRY_SQL, UPSERT_SQL) + """
SELECT 1 AS version, count(*) AS n_rows, 5 AS n_cols FROM reg
UNION ALL SELECT 2, count(*), 5 FROM ups""")
def q_version_counts(spark, d):
    v1 = SI.registry(spark, d)
    v2 = M.upsert(v1, SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return (A.version_counts(v1).select(F.lit(1).alias("version"), "n_rows", "n_cols")
            .unionByName(A.version_counts(v2).select(F.lit(2).alias("version"), "n_rows", "n_cols")))


def _hash_sum_sql(src: str) -> str:
    """The order-free sum of row hashes: each value as its byte length and text, NULL as N."""
    row = " || ".join(f"coalesce('V' || strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), 'N') || ';'"
                      for c in ("customer_id", "name", "nationkey", "balance", "segment"))
    return f"CAST(sum(CAST('0x' || substr(md5({row}), 1, 15) AS BIGINT)) AS VARCHAR) FROM {src}"


@query("table_fingerprint", _with(REGISTRY_SQL, UPSERT_SQL) + f"""
SELECT 1 AS version, (SELECT count(*) FROM reg) AS n_rows, (SELECT {_hash_sum_sql('reg')}) AS row_hash_sum, 5 AS n_cols
UNION ALL
SELECT 2, (SELECT count(*) FROM ups), (SELECT {_hash_sum_sql('ups')}), 5""")
def q_table_fingerprint(spark, d):
    v1 = SI.registry(spark, d)
    v2 = M.upsert(v1, SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return (M.fingerprint(v1).select(F.lit(1).alias("version"), "n_rows", "row_hash_sum", "n_cols")
            .unionByName(M.fingerprint(v2).select(F.lit(2).alias("version"), "n_rows", "row_hash_sum", "n_cols")))


# -- W2 / H13 ---------------------------------------------------------------------------

@query("row_ids", """
SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS row_id,
       coalesce(CASE WHEN c_acctbal >= 0 THEN c_name END,
                'ROW_' || CAST(row_number() OVER (ORDER BY c_custkey) AS VARCHAR)) AS row_label
FROM customer""")
def q_row_ids(spark, d):
    c = R.row_ids(_t(spark, d, "customer"), ["c_custkey"])
    name = F.when(F.col("c_acctbal") >= 0, F.col("c_name"))
    return c.select("c_custkey", "row_id", X.default_row_id(name, "row_id").alias("row_label"))


# -- W3 / D16 / D20 / M6 / M7 -----------------------------------------------------------

@query("stratified_split", """
WITH c AS (SELECT quality AS label, count(*) AS n_c FROM labels GROUP BY quality),
t AS (SELECT sum(n_c) AS n, ceil(0.2 * sum(n_c)) AS n_test FROM c),
a AS (SELECT label, n_c, (SELECT n_test FROM t) * n_c / (SELECT n FROM t) AS ex FROM c),
b AS (SELECT label, n_c, floor(ex) AS base, ex - floor(ex) AS frac FROM a),
r AS (SELECT *, row_number() OVER (ORDER BY frac DESC, label) AS rr,
             (SELECT n_test FROM t) - sum(base) OVER () AS rem FROM b),
k AS (SELECT label, n_c, CAST(base + CASE WHEN rr <= rem THEN 1 ELSE 0 END AS BIGINT) AS take FROM r)
SELECT l.doc_id, l.quality AS label,
       CASE WHEN row_number() OVER (PARTITION BY l.quality
                                    ORDER BY md5(CAST(l.doc_id AS VARCHAR) || ':42'), l.doc_id) <= k.take
            THEN 'test' ELSE 'train' END AS part
FROM labels l JOIN k ON l.quality IS NOT DISTINCT FROM k.label""")
def q_stratified_split(spark, d):
    lab = _t(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return R.stratified_split(lab, "label", "doc_id")


@query("class_weights", """
SELECT quality AS label, count(*) AS n_class,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight
FROM labels GROUP BY quality""")
def q_class_weights(spark, d):
    lab = _t(spark, d, "labels").select(F.col("quality").alias("label"))
    return A.class_weights(lab, "label").select("label", "n_class", r6("weight").alias("weight"))


@query("class_balance", """
SELECT quality AS label, count(*) AS n_class, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share_pct
FROM labels GROUP BY quality""")
def q_class_balance(spark, d):
    lab = _t(spark, d, "labels").select(F.col("quality").alias("label"))
    return A.class_balance(lab, "label").select("label", "n_class", r6("share_pct").alias("share_pct"))


@query("binary_metrics", _with(SCORED_SQL) + """
SELECT tp, fp, tn, fn,
       round(coalesce((tp + tn) / nullif(CAST(tp + fp + tn + fn AS DOUBLE), 0), 0), 4) AS accuracy,
       round(coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0), 4) AS precision,
       round(coalesce(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 0), 4) AS recall,
       round(coalesce(2 * tp / nullif(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0), 4) AS f1
FROM (SELECT count(*) FILTER (WHERE label = 1 AND score > 0.5) AS tp,
             count(*) FILTER (WHERE label <> 1 AND score > 0.5) AS fp,
             count(*) FILTER (WHERE label <> 1 AND NOT score > 0.5) AS tn,
             count(*) FILTER (WHERE label = 1 AND NOT score > 0.5) AS fn FROM scored)""")
def q_binary_metrics(spark, d):
    s = SI.scored_labels(spark, d).withColumn("pred", F.col("score") > 0.5)
    return MT.binary_metrics(s, "label", "pred")


@query("roc_auc", _with(SCORED_SQL) + """
SELECT round(CASE WHEN P > 0 AND N > 0 THEN (rs - P * (P + 1) / 2.0) / (P * N) ELSE 0.0 END, 4) AS roc_auc
FROM (SELECT sum(CASE WHEN label = 1 THEN ar ELSE 0 END) AS rs,
             CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS P,
             CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS N
      FROM (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar
            FROM scored WHERE score IS NOT NULL))""")
def q_roc_auc(spark, d):
    return MT.roc_auc(SI.scored_labels(spark, d), "label", "score")


# -- M1 / M2 / F3 / B11 / M11 / U1 ------------------------------------------------------

@query("zscore", _with(C360_SQL) + """
SELECT customer_id, round((monthly_charge - (SELECT avg(monthly_charge) FROM c360))
                          / nullif((SELECT stddev_pop(monthly_charge) FROM c360), 0), 6) AS monthly_charge_z
FROM c360""")
def q_zscore(spark, d):
    z = MT.zscore(SI.customer_360(spark, d, columns=["monthly_charge"]), ["monthly_charge"])
    return z.select("customer_id", r6("monthly_charge_z").alias("monthly_charge_z"))


@query("one_hot_counts", _with(C360_SQL) + """
SELECT "column", value, n_rows,
       CAST(row_number() OVER (PARTITION BY "column" ORDER BY n_rows DESC, value) - 1 AS INTEGER) AS slot
FROM (SELECT 'contract' AS "column", contract AS value, count(*) AS n_rows FROM c360 WHERE contract IS NOT NULL GROUP BY 2
      UNION ALL
      SELECT 'segment', segment, count(*) FROM c360 WHERE segment IS NOT NULL GROUP BY 2)""")
def q_one_hot_counts(spark, d):
    return MT.category_slots(SI.customer_360(spark, d, columns=["contract", "segment"]), ["contract", "segment"])


@query("topk_values", """
SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15""")
def q_topk_values(spark, d):
    p = _t(spark, d, "part")
    return p.select("p_partkey", "p_name", "p_retailprice").orderBy(F.desc("p_retailprice"), "p_partkey").limit(S.TOP_IMPORTANCES)


@query("scatter_points", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def q_scatter_points(spark, d):
    return C.scatter_points(_t(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


WHATIF_CONTRACTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("whatif_grid", _with(C360_SQL) + """
SELECT c.customer_id, s.contract, c.monthly_charge, c.total_charges,
       'No' AS "Multiple Lines", 'No' AS "Online Security", 'No' AS "Online Backup",
       'No' AS "Device Protection", 'No' AS "Tech Support", 'No' AS "Streaming TV", 'No' AS "Streaming Movies"
FROM c360 c, (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) s(contract)""")
def q_whatif_grid(spark, d):
    from churnspark.ml import score as SC
    base = SI.customer_360(spark, d, columns=["monthly_charge", "total_charges"])
    return SC.whatif_grid(base, {"contract": WHATIF_CONTRACTS})


CHART_SPECS = [CH.ChartSpec("bar", x="segment", y="monthly_charge", aggregation="mean"),
               CH.ChartSpec("pie", x="contract", y="total_charges", aggregation="sum"),
               CH.ChartSpec("histogram", x="n_orders", bins=10),
               CH.ChartSpec("line", x="n_orders", y="total_charges", aggregation="max"),
               CH.ChartSpec("box", x="segment", y="monthly_charge"),
               CH.ChartSpec("scatter", x="n_orders", y="monthly_charge", color="segment"),
               CH.ChartSpec("heatmap", columns=("monthly_charge", "total_charges", "n_orders", "balance"))]


def _chart_box_sql(i: int) -> str:
    """Box statistics of monthly_charge by segment as (chart, label, value)."""
    stats = {"q1": "f.q1", "median": "f.median", "q3": "f.q3",
             "whisker_low": "min(CASE WHEN y >= f.q1 - 1.5 * (f.q3 - f.q1) THEN y END)",
             "whisker_high": "max(CASE WHEN y <= f.q3 + 1.5 * (f.q3 - f.q1) THEN y END)",
             "n_outliers": "CAST(count(CASE WHEN y < f.q1 - 1.5 * (f.q3 - f.q1) OR y > f.q3 + 1.5 * (f.q3 - f.q1) "
                           "THEN 1 END) AS DOUBLE)"}
    return "\nUNION ALL\n".join(
        f"SELECT '{i}:box', coalesce(f.segment, '') || '|{name}', round({sql}, 6) FROM bq f "
        f"JOIN (SELECT segment, monthly_charge AS y FROM c360 WHERE monthly_charge IS NOT NULL) v "
        f"ON v.segment IS NOT DISTINCT FROM f.segment GROUP BY f.segment, f.q1, f.median, f.q3"
        for name, sql in stats.items())


def _chart_heatmap_sql(i: int, cols) -> str:
    parts = []
    for a in cols:
        for b in cols:
            both = f"{a} IS NOT NULL AND {b} IS NOT NULL"
            va, vb = f"var_pop({a}) FILTER (WHERE {both})", f"var_pop({b}) FILTER (WHERE {both})"
            cv = f"covar_pop({a}, {b}) FILTER (WHERE {both})"
            r = f"CASE WHEN {va} * {vb} > 0 THEN greatest(-1.0, least(1.0, {cv} / sqrt({va} * {vb}))) END"
            parts.append(f"SELECT '{i}:heatmap', '{a}|{b}', round({r}, 6) FROM c360")
    return "\nUNION ALL\n".join(parts)


@query("chart_spec_run", _with(C360_SQL) + """,
h AS (SELECT min(n_orders) AS lo, (max(n_orders) - min(n_orders)) / 10.0 AS w FROM c360 WHERE n_orders IS NOT NULL),
hb AS (SELECT CAST(CASE WHEN (SELECT w FROM h) > 0
                   THEN least(floor((n_orders - (SELECT lo FROM h)) / (SELECT w FROM h)), 9) ELSE 0 END AS INTEGER) AS bin
       FROM c360 WHERE n_orders IS NOT NULL),
bq AS (SELECT segment, quantile_cont(monthly_charge, 0.25) AS q1, quantile_cont(monthly_charge, 0.5) AS median,
              quantile_cont(monthly_charge, 0.75) AS q3
       FROM c360 WHERE monthly_charge IS NOT NULL GROUP BY segment)
SELECT '0:bar' AS chart, CAST(segment AS VARCHAR) AS label, round(avg(monthly_charge), 6) AS value FROM c360 GROUP BY segment
UNION ALL
SELECT '1:pie', CAST(contract AS VARCHAR),
       round(coalesce(sum(total_charges), 0) / sum(coalesce(sum(total_charges), 0)) OVER (), 6) FROM c360 GROUP BY contract
UNION ALL
SELECT '2:histogram', CAST(b.bin AS VARCHAR), CAST(coalesce(c.cnt, 0) AS DOUBLE)
FROM range(0, 10) b(bin) LEFT JOIN (SELECT bin, count(*) AS cnt FROM hb GROUP BY bin) c ON b.bin = c.bin
UNION ALL
SELECT '3:line', CAST(n_orders AS VARCHAR), max(total_charges) FROM c360 GROUP BY n_orders
UNION ALL
""" + _chart_box_sql(4) + """
UNION ALL
SELECT '5:scatter', concat_ws('|', coalesce(CAST(n_orders AS VARCHAR), ''), coalesce(segment, '')), round(monthly_charge, 6) FROM c360
UNION ALL
""" + _chart_heatmap_sql(6, CHART_SPECS[6].columns))
def q_chart_spec_run(spark, d):
    out = CH.run_long(SI.customer_360(spark, d), CHART_SPECS)
    return out.select("chart", "label", r6("value").alias("value"))


# -- M3-M9: train the forest on the merged customers, then score every customer ----------
# rows-only: MLlib forests have no SQL twin (bounds are checked in tests/test_ml.py)

@query("churn_model_scores")
def q_churn_model_scores(spark, d):
    from churnspark.ml import model as ML
    frame = SI.model_frame(spark, d)
    result = ML.train(frame)
    return ML.score(result.model, frame.drop("churn_value"), result.metadata["model_version"])


# -- M10: per-row results of two files, one of which lacks a required field -----------------

@query("score_rows_status", _with(C360_SQL) + """
SELECT CASE WHEN contract IS NULL THEN 'N/A' ELSE CAST(customer_id AS VARCHAR) END AS customer_id, 'OK' AS status,
       CAST(NULL AS VARCHAR) AS error, TRUE AS has_probability, FALSE AS failed FROM c360
UNION ALL
SELECT CAST(customer_id AS VARCHAR), 'Error', 'missing required value: Contract', FALSE, TRUE FROM c360""")
def q_score_rows_status(spark, d):
    from churnspark.ml import model as ML
    frame = SI.model_frame(spark, d)
    # the statuses do not depend on the forest, so a small one does
    fitted = ML.train(frame, num_trees=5, max_depth=4)
    rows = frame.drop("churn_value")
    # a blank id is "N/A"
    blank = rows.withColumn("customer_id", F.when(F.col("contract").isNull(), " ").otherwise(F.col("customer_id").cast("string")))
    both = ML.score_with_status(fitted.model, blank, "v").unionByName(ML.score_with_status(fitted.model, rows.drop("contract"), "v"))
    return both.select("customer_id", "status", "error", F.col("probability").isNotNull().alias("has_probability"),
                       (F.col("prediction") == "Error").alias("failed"))


# -- J3 / J5 not-found reports, J4 two-way diff, T19 type errors, B3, B4 -----------------

@query("update_not_found", _with(REGISTRY_SQL) + """
SELECT DISTINCT customer_id FROM inc WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.customer_id = inc.customer_id)""")
def q_update_not_found(spark, d):
    _, missing = M.update(SI.registry(spark, d), SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return missing


@query("delete_not_found", _with(REGISTRY_SQL) + """
SELECT DISTINCT customer_id FROM inc WHERE NOT EXISTS (SELECT 1 FROM reg WHERE reg.customer_id = inc.customer_id)""")
def q_delete_not_found(spark, d):
    _, missing = M.delete(SI.registry(spark, d), SI.incoming_batch(spark, d).select("customer_id"), "customer_id")
    return missing


@query("removed_rows", _with(REGISTRY_SQL, UPSERT_SQL) + """
SELECT * FROM reg WHERE NOT EXISTS (
  SELECT 1 FROM ups WHERE reg.customer_id IS NOT DISTINCT FROM ups.customer_id
    AND reg.name IS NOT DISTINCT FROM ups.name AND reg.nationkey IS NOT DISTINCT FROM ups.nationkey
    AND reg.balance IS NOT DISTINCT FROM ups.balance AND reg.segment IS NOT DISTINCT FROM ups.segment)""")
def q_removed_rows(spark, d):
    v1 = SI.registry(spark, d)
    v2 = M.upsert(v1, SI.incoming_batch(spark, d), "customer_id", order=SI.EVENTS_ORDER)
    return M.removed_rows(v2, v1)


@query("type_errors", _with(DIRTY_SQL) + """
SELECT CAST(event_id AS VARCHAR) AS customer_id, 'age' AS "column", raw AS value
FROM dirty WHERE raw IS NOT NULL
  AND (NOT regexp_matches(raw, '^\\s*[+-]?[0-9]+\\s*$') OR TRY_CAST(raw AS INTEGER) IS NULL)
UNION ALL
SELECT CAST(event_id AS VARCHAR), 'monthly_charge', raw
FROM dirty WHERE raw IS NOT NULL AND TRY_CAST(raw AS DECIMAL(10,2)) IS NULL""")
def q_type_errors(spark, d):
    # integers accept digits only (as the source database does): " 46.5 " and "130e1" fail
    x = _dirty(spark, d).select(F.col("event_id").cast("string").alias("customer_id"),
                                F.col("raw").alias("age"), F.col("raw").alias("monthly_charge"))
    return M.type_errors(x, {"age": "int", "monthly_charge": "decimal(10,2)"}, "customer_id")


@query("header_normalise", """
SELECT c_custkey AS customer_id, c_acctbal AS monthly_charges, c_mktsegment AS payment_method FROM customer""")
def q_header_normalise(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias(" Customer ID "),
                                        F.col("c_acctbal").alias("Monthly Charges"),
                                        F.col("c_mktsegment").alias("Payment Method"))
    return C.normalise_headers(c)


@query("whitelist_fields", """
SELECT c_custkey AS customer_id, c_mktsegment AS contract, c_acctbal AS monthly_charge FROM customer""")
def q_whitelist_fields(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"),
                                        F.col("c_name").alias("nickname"),          # unknown: ignored
                                        F.col("c_mktsegment").alias("contract"),
                                        F.col("c_acctbal").alias("monthly_charge"))
    return C.whitelist(c)


# -- §3.4 dashboard overview: one persisted filtered frame, five panels ------------------

OVERVIEW_COLUMNS = {"contract": "contract", "internet": "segment", "tenure": "n_orders", "label": "churn_label",
                    "monthly": "monthly_charge", "churn": "churn_value", "cltv": "total_charges"}


@query("dashboard_overview", _with(C360_SQL) + """,
f AS (SELECT *, CASE WHEN churn_value = 1 THEN 'Yes' WHEN churn_value = 0 THEN 'No' END AS churn_label
      FROM c360 WHERE contract IN ('1-URGENT', '2-HIGH', '3-MEDIUM')),
hv AS (SELECT churn_label, CAST(n_orders AS DOUBLE) AS x FROM f WHERE n_orders IS NOT NULL),
hs AS (SELECT min(x) AS lo, (max(x) - min(x)) / 30.0 AS w FROM hv),
hc AS (SELECT churn_label, CAST(CASE WHEN (SELECT w FROM hs) > 0
                 THEN least(floor((x - (SELECT lo FROM hs)) / (SELECT w FROM hs)), 29) ELSE 0 END AS INTEGER) AS bin,
              count(*) AS cnt FROM hv GROUP BY ALL),
hf AS (SELECT g.churn_label, b.bin FROM (SELECT DISTINCT churn_label FROM hv) g, range(0, 30) b(bin))
SELECT 'kpi' AS panel, 'customers' AS label, CAST(count(*) AS DOUBLE) AS value FROM f
UNION ALL SELECT 'kpi', 'churn_rate_pct', round(coalesce(avg(churn_value) * 100.0, 0.0), 6) FROM f
UNION ALL SELECT 'kpi', 'avg_cltv', round(coalesce(avg(total_charges), 0.0), 6) FROM f
UNION ALL SELECT 'kpi', 'avg_tenure', round(coalesce(avg(n_orders), 0.0), 6) FROM f
UNION ALL SELECT 'rate_by_contract', CAST(contract AS VARCHAR), round(avg(churn_value) * 100.0, 6)
          FROM f WHERE contract IS NOT NULL GROUP BY contract
UNION ALL SELECT 'rate_by_internet', CAST(segment AS VARCHAR), round(avg(churn_value) * 100.0, 6)
          FROM f WHERE segment IS NOT NULL GROUP BY segment
UNION ALL SELECT 'tenure_histogram', concat_ws('|', hf.churn_label, CAST(hf.bin AS VARCHAR)), CAST(coalesce(hc.cnt, 0) AS DOUBLE)
          FROM hf LEFT JOIN hc ON hf.churn_label IS NOT DISTINCT FROM hc.churn_label AND hf.bin = hc.bin
UNION ALL SELECT 'monthly_box', coalesce(churn_label, ''), round(quantile_cont(monthly_charge, 0.5), 6)
          FROM f WHERE monthly_charge IS NOT NULL GROUP BY churn_label""")
def q_dashboard_overview(spark, d):
    from churnspark.plans import dashboard as DB
    c = SI.customer_360(spark, d, columns=["contract", "segment", "monthly_charge", "total_charges", "n_orders", "churn_value"])
    c = c.withColumn("churn_label", F.when(F.col("churn_value") == 1, "Yes").when(F.col("churn_value") == 0, "No"))
    ov = DB.overview(c, KPI_FILTER, OVERVIEW_COLUMNS)
    return ov.long_form().select("panel", "label", r6("value").alias("value"))
