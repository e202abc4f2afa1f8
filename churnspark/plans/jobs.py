"""Composed jobs: ingest, bulk upload, train, score.

Each job is a short chain of the operators, writing through the versioned table / model
folders; none of them pulls data through the driver beyond one-row summaries.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnspark import schema as S
from churnspark.ml import model as ML
from churnspark.operators import analytics as A
from churnspark.operators import clean as C
from churnspark.operators import merge as M
from churnspark.session import cut_lineage
from churnspark.sources import readers as RD
from churnspark.sources.tables import VersionedTable, append_logs, export_csv
from churnspark.streaming.jobs import typed_upload

TOPICS = ("location", "demographics", "services", "status")


# -- §3.1 load: four topic files -> merged table -> upsert -----------------------------

def ingest_topics(spark: SparkSession, paths: Mapping[str, str], table: VersionedTable,
                  fmt: str = "csv", orders: Mapping[str, Sequence[str]] | None = None, multiline: bool = False) -> int:
    """Read the four topic exports, merge them into one row per customer (J1, last row per
    key within a source by file order unless ``orders`` names columns), upsert into the
    table (J2) and publish a new version.  Returns the version number."""
    frames, ords = [], []
    for topic in TOPICS:
        df = RD.read_topic(spark, topic, paths[topic], fmt, multiline)
        given = (orders or {}).get(topic)
        if given:
            ords.append(list(given))
        else:
            # ingest sequence: file order
            df = RD.with_file_order(df, "_ord")
            ords.append(["_ord"])
        frames.append(df)
    merged = M.merge_sources(frames, S.KEY, orders=ords)
    full = merged.select(*[F.col(c) if c in merged.columns else F.lit(None).cast(t).alias(c)
                           for c, t, _ in S.CUSTOMER_COLUMNS])
    # one row per key by construction
    return table.upsert(full, unique=True)


# -- A2 + J2 + B9 + D18: bulk CSV upload ---------------------------------------------

@dataclass
class UploadResult:
    version: int | None
    summary: DataFrame        # (status, n): saved / error
    errors: DataFrame         # (row, error): file row numbers, header = row 1
    saved: DataFrame          # (row, customer_id) of every row that was saved


def upload_csv(spark: SparkSession, path: str, table: VersionedTable, blanks: str = "overwrite",
               multiline: bool = False) -> UploadResult:
    """``multiline``: values hold quoted line feeds.  Rows without a customer id are reported with their file row number and skipped;
    a value that does not fit its column type fails the whole upload before anything is
    written (one transaction); the rest is upserted, last row per key winning."""
    raw = RD.read_upload_csv(spark, path, multiline=multiline)
    # written once: the checks, the merge and the lazy results below read the parsed rows, not the file
    numbered = cut_lineage(RD.file_row_numbers(raw, "_row").withColumn("_row", F.col("_row") + 1))  # header = row 1
    cleaned = C.blanks_to_null(numbered)
    status = F.when(C.has_key(S.KEY), F.lit("saved")).otherwise(F.lit("error"))
    with_status = cleaned.withColumn("status", status)
    errors = with_status.filter(F.col("status") == "error").select(
        F.col("_row").alias("row"), F.lit(f"{S.KEY} is required").alias("error"))
    incoming = typed_upload(with_status.filter(F.col("status") == "saved").drop("status"), S.KEY,
                            passthrough=("_row",))
    last = table.latest_version()
    base = table.read(last) if last is not None else spark.createDataFrame([], S.customer_schema())
    merged, strategy = M.upsert_plan(base, incoming, S.KEY, blanks=blanks, order=["_row"])
    version = table.publish(merged, clustered=strategy == "broadcast")
    saved = incoming.select(F.col("_row").alias("row"), S.KEY)
    return UploadResult(version, A.load_summary(with_status, "status"), errors, saved)


# -- §3.2 train from the table ---------------------------------------------------------

def train_from_table(table: VersionedTable, model_dir: str, version: int | None = None, **forest) -> dict:
    result = ML.train(table.read(version), **forest)
    ML.save(result, model_dir)
    return result.metadata


# -- §3.3 score a file -------------------------------------------------------------------

def score_file(spark: SparkSession, path: str, model_dir: str, out_path: str | None = None,
               log_path: str | None = None, with_status: bool = False, multiline: bool = False) -> DataFrame:
    """Read a scoring file, score every row with the current model, optionally log the rows
    that carry an id and export the result as CSV."""
    model, meta = ML.load(spark, model_dir)
    version = meta["model_version"] if meta else None
    df = RD.read_scoring_file(spark, path, multiline)
    res = ML.score_with_status(model, df, version) if with_status else ML.score(model, df, version)
    if log_path and out_path and not with_status:
        res = cut_lineage(res)               # scored once for the log and the export
    if log_path and not with_status:
        append_logs(spark, log_path, C.loggable(res, S.KEY), version)
    if out_path:
        export_csv(res, out_path)
    return res
