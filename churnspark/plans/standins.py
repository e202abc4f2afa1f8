"""Driver tables as stand-ins for the churn inputs.

The telco files are not part of the driver data, so the operators (which are
column-generic) are fed frames derived from the driver tables.  The keys of the sources
differ by nature (event users are account numbers in steps of ACCOUNT_STEP), so the merge
really produces matched and unmatched keys and NULLs without any filter:

location      every customer, with segment, nation (state) and region (country)
demographics  the last event of every user: balance
services      the last order of every customer
status        per-customer order history: total charges, order count (tenure stand-in),
              churned = no order on or after 2001-01-01

Every frame reads the whole table it derives from; nothing is filtered, sampled or capped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark.operators import merge as M

CHURN_CUTOFF = "2001-01-01 00:00:00"
#: Event user u is account u * ACCOUNT_STEP: some accounts are customers, some are not.
ACCOUNT_STEP = 20


_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet read, reused per session: the driver tables are immutable, so one file
    listing and footer read serves every query (the DataFrame is a plan, not data)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark, path)                  # the session object itself, never a recyclable id
    df = _TABLES.get(key)
    if df is None or df.sparkSession is not spark:
        df = _TABLES[key] = spark.read.parquet(path)
    return df


def location(spark: SparkSession, d: str) -> DataFrame:
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    # nation (25 rows) and region (5 rows) are fixed-size dimensions; Spark broadcasts them
    return (c.join(n, c.c_nationkey == n.n_nationkey, "left")
             .join(r, n.n_regionkey == r.r_regionkey, "left")
             .select(F.col("c_custkey").alias("customer_id"),
                     F.col("r_name").alias("country"), F.col("n_name").alias("state"),
                     F.col("c_mktsegment").alias("segment")))


def demographics(spark: SparkSession, d: str) -> DataFrame:
    """All events; the merge keeps the last per account by (ts, event_id)."""
    return table(spark, d, "events").select((F.col("user_id") * ACCOUNT_STEP).alias("customer_id"),
                                            F.col("value").alias("balance"), "ts", "event_id")


def services_rows(spark: SparkSession, d: str) -> DataFrame:
    """All orders; the merge keeps the last per customer by (o_orderdate, o_orderkey)."""
    return (table(spark, d, "orders")
            .select(F.col("o_custkey").alias("customer_id"),
                    F.col("o_orderpriority").alias("contract"),
                    F.col("o_totalprice").alias("monthly_charge"),
                    "o_orderdate", "o_orderkey"))


EVENTS_ORDER = ["ts", "event_id"]
SERVICES_ORDER = ["o_orderdate", "o_orderkey"]


def status(spark: SparkSession, d: str) -> DataFrame:
    return (table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer_id"))
            .agg(F.round(F.sum("o_totalprice"), 2).alias("total_charges"),
                 F.count(F.lit(1)).alias("n_orders"),
                 F.when(F.max("o_orderdate") < F.lit(CHURN_CUTOFF).cast("timestamp_ntz"), 1)
                  .otherwise(0).alias("churn_value")))


def customer_360(spark: SparkSession, d: str, strategy: str = "aggregate", columns: list[str] | None = None) -> DataFrame:
    """J1 over the four stand-in sources (one row per customer); ``columns``: those wanted beside
    the key.  Both orders end in a row id, and location and status hold a key once."""
    return M.merge_sources(
        [location(spark, d), demographics(spark, d), services_rows(spark, d), status(spark, d)],
        key="customer_id", orders=[None, EVENTS_ORDER, SERVICES_ORDER, None], strategy=strategy,
        columns=columns, no_ties=True)


# -- old / incoming tables for the merge family --------------------------------------

def registry(spark: SparkSession, d: str) -> DataFrame:
    """The stored table: every customer."""
    return (table(spark, d, "customer")
            .select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
                    F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance"),
                    F.col("c_mktsegment").alias("segment")))


def incoming_batch(spark: SparkSession, d: str) -> DataFrame:
    """An arriving batch: every event, so keys repeat and need EVENTS_ORDER.  Some keys are in
    the table and some are new; name and nationkey are absent."""
    return table(spark, d, "events").select((F.col("user_id") * ACCOUNT_STEP).alias("customer_id"),
                                            F.col("value").alias("balance"),
                                            F.col("event_type").alias("segment"), "ts", "event_id")


# -- inference log stand-in ----------------------------------------------------------

def inference_log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    p = F.round(F.col("value") / (F.col("value") + F.lit(100.0)), 4)
    return e.select(F.col("event_id").alias("inference_id"),
                    F.col("user_id").cast("string").alias("customer_id"),
                    p.alias("churn_probability"),
                    (p > 0.5).alias("predicted_churn"),
                    F.lit("v1.0").alias("model_version"),
                    F.col("ts").alias("created_at"))


# -- labels and scores ---------------------------------------------------------------

def scored_labels(spark: SparkSession, d: str) -> DataFrame:
    lab, doc = table(spark, d, "labels"), table(spark, d, "documents")
    return (lab.join(doc.select("doc_id", "n_chars"), on="doc_id", how="inner")
               .select("doc_id", F.col("quality").alias("label"),
                       F.round(F.col("n_chars") / (F.col("n_chars") + F.lit(1500.0)), 4).alias("score")))


# -- model frame ---------------------------------------------------------------------

def model_frame(spark: SparkSession, d: str) -> DataFrame:
    """Customer-360 in the model's name space (snake_case aliases): three numerics and the
    sixteen categoricals, each derived from a stand-in column; NULLs from the merge stay
    NULL (the training job drops those rows, the scorer handles them)."""
    c = customer_360(spark, d)
    yn = lambda cond: F.when(cond, "Yes").when(cond.isNotNull(), "No")
    return c.select(
        "customer_id",
        F.col("n_orders").alias("tenure_in_months"),
        F.col("monthly_charge"),
        F.col("total_charges"),
        F.col("segment").alias("gender"),
        yn(F.col("monthly_charge") > 250000).alias("senior_citizen"),
        yn(F.col("total_charges") > 1500000).alias("partner"),
        yn(F.col("n_orders") > 12).alias("dependents"),
        yn(F.col("monthly_charge") > 150000).alias("phone_service"),
        yn(F.col("monthly_charge") > 300000).alias("multiple_lines"),
        F.col("country").alias("internet_service"),
        yn(F.col("total_charges") > 2000000).alias("online_security"),
        yn(F.col("total_charges") > 1000000).alias("online_backup"),
        yn(F.col("n_orders") > 10).alias("device_protection"),
        yn(F.col("total_charges") > 3000000).alias("tech_support"),
        yn(F.col("n_orders") > 8).alias("streaming_tv"),
        yn(F.col("n_orders") > 15).alias("streaming_movies"),
        F.col("contract"),
        yn(F.col("monthly_charge") > 100000).alias("paperless_billing"),
        F.col("state").alias("payment_method"),
        F.col("churn_value"))
