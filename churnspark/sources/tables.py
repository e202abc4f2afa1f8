"""Sinks and stored tables: versioned table (upsert target, snapshots), the inference log,
result export and run metadata.

A table is a folder of immutable Parquet snapshots, one folder per write attempt, plus a small
catalog (also Parquet) that says which attempt is which version.  An attempt is written first and
only then claims its version number, so readers never see a half-written version, a job never
overwrites the path it reads (the Spark form of the source system's single transaction), and what a
lost writer leaves behind is never read and blocks nobody.  Paths must be on shared storage (the same
file system as ``spark.checkpoint.dir``).
"""

from __future__ import annotations

import datetime as dt
import uuid
import warnings
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.operators import merge as M
from churnspark.operators import rows as R
from churnspark.sources.claims import Taken, claim, claims, is_void, read_if_there, settle

CATALOG_SCHEMA = "version int, created_at timestamp, n_rows long, n_cols int, row_hash_sum string, schema string, attempt string"
#: What a version's claim holds, and what is learned about it later.
ENTRY_SCHEMA = "attempt string, created_at timestamp, n_cols int, schema string"
FACTS_SCHEMA = "version int, n_rows long, row_hash_sum string"


class VersionNotFound(LookupError):
    pass


class VersionConflict(RuntimeError):
    """Another writer took the number of the next version.  Nothing was changed."""


@dataclass
class VersionedTable:
    spark: SparkSession
    path: str
    key: str | None = S.KEY
    files_per_version: int | None = None
    #: How long the row of a claimed version may be missing before its writer counts as lost.
    settle_seconds: float = 30.0

    # -- catalog -------------------------------------------------------------------
    @property
    def _catalog_path(self) -> str:
        return f"{self.path.rstrip('/')}/_catalog"

    @property
    def _facts_path(self) -> str:
        return f"{self.path.rstrip('/')}/_facts"

    def _entries(self) -> DataFrame:
        return claims(self.spark, self._catalog_path, ENTRY_SCHEMA).withColumnRenamed("n", "version")

    def versions(self) -> DataFrame:
        """One row per version; ``n_rows`` and ``row_hash_sum`` once they are known."""
        facts = read_if_there(self.spark, self._facts_path, FACTS_SCHEMA)
        facts = self.spark.createDataFrame([], FACTS_SCHEMA) if facts is None else facts
        facts = facts.groupBy("version").agg(F.max("n_rows").alias("n_rows"), F.max("row_hash_sum").alias("row_hash_sum"))
        names = [x.split()[0] for x in CATALOG_SCHEMA.split(", ")]
        return self._entries().join(facts, "version", "left").select(*names)

    def latest_version(self) -> int | None:
        row = self._entries().agg(F.max("version")).first()
        return row[0] if row else None

    # -- read ----------------------------------------------------------------------
    def read(self, version: int | None = None) -> DataFrame:
        v = self.latest_version() if version is None else version
        known = self._entries().filter(F.col("version") == F.lit(v)).select("attempt").collect() if v is not None else []
        if not known:
            raise VersionNotFound(f"version {version} is not available in {self.path}")
        return self.spark.read.parquet(self._data_path(known[0]["attempt"]))

    def read_or_warn(self, version: int | None = None) -> DataFrame | None:
        try:
            return self.read(version)
        except VersionNotFound as e:
            warnings.warn(str(e))
            return None

    def cached(self, version: int | None = None) -> DataFrame:
        """The caller's cache of one immutable version (no time-based expiry needed:
        a version never changes; a newer one is a different path)."""
        return self.read(version).persist(StorageLevel.MEMORY_AND_DISK)

    # -- write ---------------------------------------------------------------------
    def publish(self, df: DataFrame, fingerprint_row=None, clustered: bool = False) -> int:
        """Write ``df`` in a folder of its own, then claim the next version number for it.  Rows
        are range-partitioned and sorted by key so Parquet min/max statistics serve key lookups.
        ``clustered`` says that ``df`` keeps the partitions of a version that was (a small batch
        merged without a shuffle): they are written as they stand, and ``df`` is evaluated once.
        The fingerprint is kept when the caller already computed it (snapshot path); otherwise it
        is computed from the version's files only when first needed.

        A writer that lost the number to another raises ``VersionConflict``; a writer that was lost
        itself, at whatever point, leaves nothing that a later one has to clear away."""
        last = self.latest_version()
        v = 1 if last is None else last + 1
        out = df
        if self.key and self.key in df.columns and not clustered:
            out = (out.repartitionByRange(self.files_per_version, self.key) if self.files_per_version
                   else out.repartitionByRange(self.key)).sortWithinPartitions(self.key)
        attempt = uuid.uuid4().hex
        out.write.mode("errorifexists").parquet(self._data_path(attempt))
        # the version's files exist now; frames measured on the way are no longer needed
        R.release_caches()
        v = self._record(v, attempt, len(df.columns), df.schema.simpleString())
        if fingerprint_row:
            self._learn(v, fingerprint_row)
        return v

    def _data_path(self, attempt: str) -> str:
        return f"{self.path.rstrip('/')}/data/attempt-{attempt}"

    def _record(self, v: int, attempt: str, n_cols: int, schema: str) -> int:
        """Claim version ``v``, or the first after it that no lost writer made void."""
        while True:
            now = dt.datetime.now(dt.timezone.utc)
            try:
                claim(self.spark, self._catalog_path, v, (attempt, now, n_cols, schema), ENTRY_SCHEMA)
                return v
            except Taken as e:
                if settle(self.spark, self._catalog_path, v, ENTRY_SCHEMA, self.settle_seconds):
                    raise VersionConflict(f"{self.path}: version {v} was taken by another writer") from e
                v += 1

    def _learn(self, v: int, fp: dict) -> None:
        self.spark.createDataFrame([(v, fp["n_rows"], fp["row_hash_sum"])], FACTS_SCHEMA) \
            .coalesce(1).write.mode("append").parquet(self._facts_path)

    def fingerprint_of(self, version: int) -> dict:
        """Catalog fingerprint of a version; computed from its files (one aggregate pass)
        and recorded the first time it is asked for."""
        rows = (self.versions().filter((F.col("version") == version) & F.col("row_hash_sum").isNotNull())
                .limit(1).collect())
        if rows:
            return rows[0].asDict()
        fp = M.fingerprint(self.read(version)).first().asDict()
        self._learn(version, fp)
        return fp

    def snapshot_if_changed(self, df: DataFrame, clustered: bool = False) -> int | None:
        """G3 + U2: publish a new version only when the bag of rows or the schema differs
        from the latest version (order-free fingerprint; one small aggregate job)."""
        fp = M.fingerprint(df).first().asDict()
        last = self.latest_version()
        if last is not None:
            old = self.fingerprint_of(last)
            if (old["n_rows"], old["row_hash_sum"], old["schema"]) == (fp["n_rows"], fp["row_hash_sum"], fp["schema"]):
                return None
        return self.publish(df, fingerprint_row=fp, clustered=clustered)

    def upsert(self, incoming: DataFrame, blanks: str = "overwrite", order=None, unique: bool = False) -> int:
        """Merge ``incoming`` into the latest version and publish the result.  Repeated keys
        need an ``order``, in the first version as in any other; ``unique`` says that there are none,
        and the batch is evaluated once less."""
        last = self.latest_version()
        if last is None:
            if unique:
                return self.publish(incoming)
            named = {c for c in (order or []) if isinstance(c, str)}
            M.require_order(incoming.drop(*named), self.key, order)
            return self.publish(M.dedup_last(incoming, self.key, order))
        merged, strategy = M.upsert_plan(self.read(last), incoming, self.key, blanks=blanks, order=order, unique=unique)
        return self.publish(merged, clustered=strategy == "broadcast")

    def diff(self, old: int, new: int) -> tuple[DataFrame, DataFrame]:
        """(rows added in ``new``, rows removed since ``old``); a changed row is in both."""
        a, b = self.read(old), self.read(new)
        return M.added_rows(b, a), M.removed_rows(b, a)

    def counts(self, version: int | None = None) -> DataFrame:
        """Rows and columns of a version, from the catalog once its fingerprint is known."""
        v = self.latest_version() if version is None else version
        self.fingerprint_of(v)
        return (self.versions().filter((F.col("version") == v) & F.col("n_rows").isNotNull())
                .groupBy("version").agg(F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols")))


# -- A13: time-limited cached view ----------------------------------------------------

class TableCache:
    """A process's cached view of a table (the dashboard's 60 s customers / 30 s logs caches).

    Within ``ttl_seconds`` the cached frame is returned as is (possibly stale, like the
    source system).  After that the catalog is checked: the same version is kept (versions
    are immutable, nothing to re-read), a newer one replaces the cache."""

    def __init__(self, table: VersionedTable, ttl_seconds: float = 60.0, clock=None):
        import time
        self.table, self.ttl = table, ttl_seconds
        self._clock = clock or time.monotonic
        self._df: DataFrame | None = None
        self._version: int | None = None
        self._checked = float("-inf")

    def get(self) -> DataFrame:
        now = self._clock()
        if self._df is not None and now - self._checked < self.ttl:
            return self._df
        latest = self.table.latest_version()
        if self._df is None or latest != self._version:
            if self._df is not None:
                self._df.unpersist(blocking=False)
            self._df = self.table.read(latest).persist(StorageLevel.MEMORY_AND_DISK)
            self._version = latest
        self._checked = now
        return self._df

    @property
    def version(self) -> int | None:
        return self._version


# -- A7: inference log append -----------------------------------------------------------

LOG_SCHEMA = ("inference_id long, customer_id string, churn_probability decimal(5,4), predicted_churn boolean, "
              "model_version string, created_at timestamp, source string, batch_id long")
RANGE_SCHEMA = "source string, batch_id long, base_id long, size long"


def append_logs(spark: SparkSession, path: str, scored: DataFrame, model_version: str | None = None,
                batch_id: int | None = None, source: str | None = None) -> int:
    """Append scored rows to the log: inference_id = start of a reserved range + global row number
    (no single-task numbering), model_version = given or the row's or the default,
    created_at = write time.  Returns the number of rows written.

    The rows are numbered first (a checkpoint), then their ids are reserved, then they are written:
    no other writer gets these ids, whatever happens to this one.  A replayed batch finds its own
    range and keeps its ids; a range that was never written is a gap.

    Every write goes to ``source=<writer>/batch_id=<n>``: a stream names itself (its query id)
    and its micro-batch, so a replayed batch replaces itself and no other writer's rows; a
    batch write is a source of its own.  The overwrite mode is an option of this one writer."""
    if batch_id is None:
        source, batch_id = f"run-{uuid.uuid4().hex}", 0
    source = source or "stream"
    version = F.coalesce(F.lit(model_version).cast("string"),
                         F.col("model_version") if "model_version" in scored.columns else F.lit(None).cast("string"),
                         F.lit(S.DEFAULT_MODEL_VERSION))
    order = ["customer_id"] + (["churn_probability"] if "churn_probability" in scored.columns else [])
    numbered = R.row_ids(scored.withColumn("_seq", F.monotonically_increasing_id()), order + ["_seq"], "_rn")
    # the numbered rows are a checkpoint (row numbering), so this reads it, not the source
    n = numbered.count()
    if not n:
        return 0
    base = reserve_ids(spark, path, source, batch_id, n)
    out = numbered.select(
        (F.lit(base) + F.col("_rn")).cast("long").alias("inference_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("churn_probability").cast("decimal(5,4)").alias("churn_probability"),
        F.col("predicted_churn").cast("boolean").alias("predicted_churn"),
        version.alias("model_version"),
        F.current_timestamp().alias("created_at"),
        F.lit(source).alias("source"), F.lit(batch_id).cast("long").alias("batch_id"))
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "batch_id").parquet(path)
    return n


# Ranges of ids handed out, one tiny claim per append; Spark's file index skips "_" folders, so
# readers of the log never see it and the next append needs no scan of the log.
RANGES_DIR = "_ids"


def reserve_ids(spark: SparkSession, path: str, source: str, batch_id: int, size: int,
                settle_seconds: float = 30.0) -> int:
    """The number before the first id of a range of ``size`` ids that no other writer has or gets.
    The batch's own range if it reserved one before and fits in it."""
    root = f"{path.rstrip('/')}/{RANGES_DIR}"
    while True:
        known = claims(spark, root, RANGE_SCHEMA)
        own = (F.col("source") == source) & (F.col("batch_id") == batch_id) & (F.col("size") >= size)
        again, top, number = known.agg(F.min(F.when(own, F.col("base_id"))), F.max(F.col("base_id") + F.col("size")),
                                       F.max("n")).first()
        if again is not None:
            return again
        if number is None:
            # a log that was written without ranges
            existing = read_if_there(spark, path, LOG_SCHEMA)
            top = 0 if existing is None else existing.agg(F.max("inference_id")).first()[0] or 0
        number = (number or 0) + 1
        while is_void(spark, root, RANGE_SCHEMA, number):
            number += 1
        try:
            claim(spark, root, number, (source, batch_id, top, size), RANGE_SCHEMA)
            return top
        except Taken:
            settle(spark, root, number, RANGE_SCHEMA, settle_seconds)


# -- A11: result export ---------------------------------------------------------------

def export_csv(df: DataFrame, path: str) -> None:
    """Flat columns only (struct/array/map dropped), every field quoted, quotes doubled,
    NULL as empty.  Written by all tasks in parallel (part files), never through one."""
    flat = [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    (df.select(*[F.col(f"`{c}`") for c in flat]).write.mode("overwrite")
       .option("header", True).option("quoteAll", True).option("escape", '"')
       .option("nullValue", "").option("emptyValue", "").csv(path))


# -- A10: run metadata ----------------------------------------------------------------

METADATA_SCHEMA = ("model_version string, trained_at string, n_train_rows long, n_test_rows long, "
              "features array<string>, metrics map<string,double>, top_feature_importances map<string,double>, "
              "class_balance_pct map<string,double>, null_targets long")


def write_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    row = (meta["model_version"], meta["trained_at"], int(meta["n_train_rows"]), int(meta["n_test_rows"]),
           list(meta["features"]), {k: float(v) for k, v in meta["metrics"].items()},
           {k: float(v) for k, v in meta["top_feature_importances"].items()},
           {k: float(v) for k, v in (meta.get("class_balance_pct") or {}).items()},
           int(meta["null_targets"]) if meta.get("null_targets") is not None else None)
    spark.createDataFrame([row], METADATA_SCHEMA).write.mode("overwrite").json(path)


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    """None when there is no metadata at the path; what cannot be read raises."""
    found = read_if_there(spark, path, METADATA_SCHEMA, "json")
    rows = [] if found is None else found.collect()
    if not rows:
        return None
    d = rows[0].asDict(recursive=True)
    d["metrics"] = {k: v for k, v in (d.get("metrics") or {}).items() if v is not None}
    for m in ("top_feature_importances", "class_balance_pct"):
        d[m] = {k: v for k, v in (d.get(m) or {}).items() if v is not None}
    return d
