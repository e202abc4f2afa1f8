"""Structured Streaming jobs.

S1  continuous scoring: arriving customer files -> model -> inference log.
S2  continuous upsert: arriving upload CSV files -> typed, checked -> versioned table; files
    that cannot be loaded go to a quarantine table and the stream goes on.

CSV streams follow the names of arriving files; each micro-batch reads its files by their own
headers, as the batch readers do, so files may order their columns differently.

Both use ``foreachBatch`` so that each micro-batch runs the same batch operators as the
batch jobs (stream result = batch result), and both are idempotent on replay: S1 writes
each batch to its own (query id, batch id) partition with dynamic overwrite, S2 publishes a new
table version only when the merged content differs from the latest one.  Checkpoints
default to ``<spark.checkpoint.dir>/streams/<name>`` (shared storage).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from churnspark import schema as S
from churnspark.ml import model as ML
from churnspark.operators import clean as C
from churnspark.operators import merge as M
from churnspark.operators.rows import release_caches
from churnspark.session import checkpoint_dir, cut_lineage
from churnspark.sources import readers as RD
from churnspark.sources.readers import with_file_order
from churnspark.sources.tables import VersionedTable


class BatchTypeError(ValueError):
    pass


def _checkpoint(spark: SparkSession, name: str, given: str | None) -> str:
    return given or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The stream's id as its checkpoint keeps it: the same after a restart, another one for
    another checkpoint folder."""
    return spark.read.schema("id string").json(f"{checkpoint.rstrip('/')}/metadata").first()[0]


def _source(spark: SparkSession, path: str, schema: T.StructType, fmt: str, max_files: int | None) -> DataFrame:
    """CSV: the paths of arriving files (their content is not read here); else the rows."""
    r = spark.readStream.schema(RD.LISTING if fmt == "csv" else schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.format("binaryFile").load(path).select("path") if fmt == "csv" else r.format(fmt).load(path)


def _files(batch: DataFrame) -> list[str]:
    return sorted(r.path for r in batch.select("path").collect())


# -- S1 ----------------------------------------------------------------------------------

def continuous_scoring(spark: SparkSession, source_path: str, schema: T.StructType, model: PipelineModel,
                       log_path: str, model_version: str | None = None, fmt: str = "csv",
                       checkpoint: str | None = None, available_now: bool = True,
                       max_files_per_trigger: int | None = None) -> StreamingQuery:
    folder = _checkpoint(spark, "scoring", checkpoint)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        if fmt == "csv":
            headers = RD.csv_headers(batch.sparkSession, files) if (files := _files(batch)) else {}
            if not headers:
                return
            named = RD.read_csv(batch.sparkSession, files, headers=headers)
            types = {f.name: f.dataType for f in schema.fields}
            batch = named.select(*[F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
                                   for c in named.columns])
        ML.score_and_log(model, batch, log_path, model_version, batch_id=batch_id, source=_query_id(spark, folder))

    w = (_source(spark, source_path, schema, fmt, max_files_per_trigger).writeStream
         .foreachBatch(per_batch).option("checkpointLocation", folder))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


# -- S2 ----------------------------------------------------------------------------------

def upload_problem(df: DataFrame, types: dict[str, str], key: str = S.KEY) -> Column:
    """What keeps a row of cleaned text from being loaded, NULL when nothing does."""
    parts = [F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(t).isNull(),
                    F.concat(F.lit(f"{c} is no {t}: "), F.col(f"`{c}`").cast("string")))
             for c, t in types.items() if c in df.columns and c != key]
    parts += [F.when(F.length(F.col(f"`{c}`")) > n, F.lit(f"{c} is longer than {n}"))
              for c, n in S.STRING_LIMITS.items() if c in df.columns]
    return F.nullif(F.concat_ws("; ", *parts), F.lit("")) if parts else F.lit(None).cast("string")


def typed_upload(batch: DataFrame, key: str = S.KEY, passthrough: tuple = ()) -> DataFrame:
    """Upload rows (all strings) -> blanks to NULL, rows without a key dropped (reported by
    ``split_rejects``), known fields cast to the table types.  Raises on a value that does not
    fit so nothing of the batch is written (one transaction).  ``passthrough`` columns are kept."""
    good, types = _known_fields(batch, key, passthrough)
    problem = upload_problem(good, types, key)
    bad = good.select(F.col(key), problem.alias("problem")).filter("problem IS NOT NULL").limit(5).collect()
    if bad:
        raise BatchTypeError(f"values that do not fit the table, e.g. {bad}")
    return C.cast_to_schema(good, types)


def _known_fields(batch: DataFrame, key: str, passthrough: tuple) -> tuple[DataFrame, dict[str, str]]:
    x = C.whitelist(C.blanks_to_null(batch), [*S.ALL_CUSTOMER_FIELDS, *passthrough], key)
    good, _ = C.split_rejects(x, key)
    return good, {c: t for c, t in S.customer_types().items() if c in good.columns}


QUARANTINE_SCHEMA = "file string, n_rows long, problem string, quarantined_at timestamp, source string, batch_id long"


def _quarantine(spark: SparkSession, path: str, source: str, batch_id: int, files: list[tuple[str, int, str]]) -> None:
    """One row per rejected file; a replayed batch replaces its own rows."""
    rows = spark.createDataFrame([(*f, None, source, batch_id) for f in files], QUARANTINE_SCHEMA)
    (rows.withColumn("quarantined_at", F.current_timestamp()).coalesce(1).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch_id").parquet(path))


def continuous_upsert(spark: SparkSession, source_path: str, table: VersionedTable, header: list[str] | None = None,
                      checkpoint: str | None = None, blanks: str = "overwrite",
                      available_now: bool = True, max_files_per_trigger: int | None = None,
                      quarantine: str | None = None, multiline: bool = False) -> StreamingQuery:
    """``header`` names the columns that are taken from the files (default: all known ones).

    A file without the key column, with a row of too few or too many fields, or with a value that
    does not fit the table is not loaded at all: it becomes a row of the ``quarantine`` table
    (default ``<table>/_quarantine``) and the other files of its batch are upserted."""
    folder = _checkpoint(spark, "upsert", checkpoint)
    dead = quarantine or f"{table.path.rstrip('/')}/_quarantine"

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        session, key = batch.sparkSession, table.key
        files = _files(batch)
        headers = RD.csv_headers(session, files) if files else {}
        rejected = [(f, 0, f"{key} is not in the header") for h, fs in headers.items() if key not in h for f in fs]
        headers = {h: fs for h, fs in headers.items() if key in h}
        if headers:
            rows = RD.read_csv(session, files, headers=headers, multiline=multiline, corrupt="_malformed")
            if header is not None:
                rows = rows.select(*[c for c in rows.columns if c in {*header, key, "_malformed"}])
            # ingest order inside the batch: file order (file, split start, position); the files are
            # parsed once, the checks and the merge read the copy
            rows = cut_lineage(with_file_order(rows, "_ord"), session)
            good, types = _known_fields(rows, key, ("_ord", "_malformed"))
            problem = F.coalesce(F.when(F.col("_malformed").isNotNull(), F.concat(F.lit("malformed row: "), F.substring("_malformed", 1, 100))),
                                 upload_problem(good, types, key))
            # a malformed row may have lost its key: rows without one are looked at as well
            broken = rows.filter(F.col("_malformed").isNotNull()).select(F.col("_ord.file").alias("file"), F.concat(
                F.lit("malformed row: "), F.substring("_malformed", 1, 100)).alias("problem"))
            bad = good.select(F.col("_ord.file").alias("file"), problem.alias("problem")).filter("problem IS NOT NULL")
            found = bad.unionByName(broken).groupBy("file").agg(F.countDistinct("problem").alias("n"), F.min("problem").alias("problem")).collect()
            rejected += [(r.file, r.n, r.problem) for r in found]
            if found:
                good = good.filter(~F.col("_ord.file").isin([r.file for r in found]))
        if rejected:
            _quarantine(session, dead, _query_id(session, folder), batch_id, rejected)
        if not headers or len(rejected) == len(files) or good.isEmpty():
            return
        incoming = C.cast_to_schema(good.drop("_malformed"), types)
        last = table.latest_version()
        # the first version starts from an empty table with the full customer schema
        base = table.read(last) if last is not None else spark.createDataFrame([], S.customer_schema())
        merged, strategy = M.upsert_plan(base, incoming, key, blanks=blanks, order=["_ord"])
        # a micro-batch small enough to broadcast leaves the table where it stands
        table.snapshot_if_changed(merged, clustered=strategy == "broadcast")
        release_caches()

    w = (_source(spark, source_path, RD.LISTING, "csv", max_files_per_trigger).writeStream
         .foreachBatch(per_batch).option("checkpointLocation", folder))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
