"""Readers: topic files, upload CSV, scoring files, JSON envelopes, ordered scans, pages
and the newest log rows.  Every reader takes an explicit schema (never inference) so that
the plan is fixed before any file is touched, and keeps parquet pushdown intact."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from churnspark import schema as S
from churnspark.operators import clean as C


def _all_strings(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def _csv(spark: SparkSession, header_names, path: str | list[str], multiline: bool = False,
         corrupt: str | None = None) -> DataFrame:
    """All-string CSV of files that share one header (which is compared with the given names).  A
    row with too few or too many fields raises (a quoted line feed without ``multiline`` makes
    such rows); with ``corrupt``, a column of that name holds the text of such a row instead.
    ``multiline`` reads quoted line feeds; a file is then one task."""
    # escape='"' keeps doubled quotes inside a quoted field ("""36.7, -119.7""") in one column
    reader = (spark.read.schema(_all_strings([*header_names, *([corrupt] if corrupt else [])])).option("header", True)
              .option("enforceSchema", False).option("escape", '"').option("multiLine", multiline)
              .option("encoding", "UTF-8").option("mode", "PERMISSIVE" if corrupt else "FAILFAST"))
    if corrupt:
        reader = reader.option("columnNameOfCorruptRecord", corrupt)
    return reader.csv(path)


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV file (reads only the first line; BOM stripped)."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        return []
    line = first[0][0].lstrip("\ufeff")
    import csv
    return next(csv.reader([line]))


#: Schema of the file listing source; only ``path`` is ever read, so no content is.
LISTING = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()),
                        T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
#: Files whose first lines are read at the same time.
HEADER_JOBS = 8


def csv_headers(spark: SparkSession, path: str | list[str]) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files (of a file, folder, glob or list) that have it, both in path order.
    Empty files are left out.  Only names and first lines reach the driver."""
    files = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())
    found: dict[tuple[str, ...], list[str]] = {}
    with ThreadPoolExecutor(HEADER_JOBS) as pool:
        for f, header in zip(files, pool.map(lambda f: tuple(csv_header(spark, f)), files)):
            if header:
                found.setdefault(header, []).append(f)
    return found


def read_csv(spark: SparkSession, path: str | list[str], required: Sequence[str] = (), multiline: bool = False,
             corrupt: str | None = None, headers: Mapping[tuple[str, ...], list[str]] | None = None) -> DataFrame:
    """All-string CSV, read by column name: files are grouped by their own header, each group is
    read with it, and the groups are put together by name.  A column that a file lacks is NULL
    there; ``required`` columns must be in every header."""
    headers = csv_headers(spark, path) if headers is None else headers
    if not headers:
        raise ValueError(f"no CSV file with a header in {path}")
    for header in headers:
        missing = [c for c in required if c not in header]
        if missing:
            raise C.MissingColumnsError(missing, list(required))
    out = None
    for header, files in headers.items():
        df = _csv(spark, header, files, multiline, corrupt)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


# -- file order (T10) -----------------------------------------------------------------

def with_file_order(df: DataFrame, name: str = "_ord") -> DataFrame:
    """Add a sortable file-order key: (file, start of the split, position in the read).
    Spark packs the splits of a large file into partitions by size, not by offset, so a
    partition index alone is not file order; the split start is.  Must be applied directly
    over a file scan (the input-file functions are empty after a shuffle)."""
    return df.withColumn(name, F.struct(F.input_file_name().alias("file"),
                                        F.input_file_block_start().alias("block"),
                                        F.monotonically_increasing_id().alias("pos")))


def file_row_numbers(df: DataFrame, name: str = "row_id") -> DataFrame:
    """1-based row number in file order (files by name, then split start, then position),
    computed without a range shuffle: rows are counted per file split (one row per split),
    the counts become offsets, and each row adds its position inside its split.  The
    numbering is a function of the files, so recomputation gives the same numbers.  Must be
    applied directly over a file scan."""
    from churnspark.operators.rows import broadcast_if_small
    from pyspark.sql import Window
    # the partition id is part of the split key: for a scan it changes nothing (a split is
    # read by one task); for a frame that is not a scan it still gives a valid numbering
    x = (df.withColumn("_file", F.input_file_name()).withColumn("_block", F.input_file_block_start())
           .withColumn("_pid", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id()))
    key = ["_file", "_block", "_pid"]
    splits = x.groupBy(*key).agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mono").alias("_first"))
    # the window runs over the split table: one row per file split
    w = Window.orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    offsets = splits.withColumn("_off", F.sum("_cnt").over(w) - F.col("_cnt")).drop("_cnt")
    out = x.join(broadcast_if_small(offsets), on=key, how="inner")
    return (out.withColumn(name, F.col("_off") + F.col("_mono") - F.col("_first") + F.lit(1))
               .drop(*key, "_mono", "_first", "_off"))


# -- A1: topic files -----------------------------------------------------------------

TOPIC_MAPS: Mapping[str, Mapping[str, str]] = {
    "location": S.LOCATION_MAP, "demographics": S.DEMOGRAPHICS_MAP,
    "services": S.SERVICES_MAP, "status": S.STATUS_MAP,
}


def read_topic(spark: SparkSession, topic: str, path: str, fmt: str = "csv", multiline: bool = False) -> DataFrame:
    """One topic export (CSV with source headers, or Parquet) -> renamed, pruned, typed."""
    mapping = TOPIC_MAPS[topic]
    if fmt == "csv":
        df = read_csv(spark, path, multiline=multiline)
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError("fmt must be 'csv' or 'parquet'")
    out = C.rename_prune(df, mapping)
    # zip codes are text even when the export stored them as numbers (H2)
    return C.cast_to_schema(out, S.customer_types())


# -- A2: upload CSV ------------------------------------------------------------------

def read_upload_csv(spark: SparkSession, path: str, key: str = S.KEY, multiline: bool = False) -> DataFrame:
    """All-string read of a bulk-upload CSV; the key column is required in every header.
    ``multiline``: free text holds quoted line feeds."""
    return read_csv(spark, path, [key], multiline)


# -- A3: scoring file ----------------------------------------------------------------

def read_scoring_file(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    """CSV or Parquet by suffix, names as in the file (scoring normalises them); an unknown
    suffix raises."""
    low = path.lower().rstrip("/")
    if low.endswith(".csv"):
        df = read_csv(spark, path, multiline=multiline)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError("unsupported file type: use .csv or .parquet (export spreadsheets first)")
    return df


# -- A4 / F1: ordered scan and pages -------------------------------------------------

def scan_ordered(df: DataFrame, key: str = S.KEY) -> DataFrame:
    return df.orderBy(key)


def page(df: DataFrame, key: str = S.KEY, limit: int | None = None, offset: int = 0) -> DataFrame:
    """``ORDER BY key LIMIT n OFFSET o``; the offset is ignored without a limit."""
    ordered = df.orderBy(key)
    if limit is None:
        return ordered
    return ordered.offset(offset).limit(limit) if offset else ordered.limit(limit)


# -- A5: JSON envelope ---------------------------------------------------------------

def read_json_records(spark: SparkSession, path: str, schema: T.StructType | None = None,
                      field: str = "customers", lines: bool = False) -> DataFrame:
    """A bare JSON array of records, or an envelope ``{count, customers: [...]}``.
    Either is one document, which one task must read whole; ``lines`` reads one record per
    line, split over many tasks, and is the form for large sources.
    Raises when no record is found (no job beyond an emptiness probe)."""
    schema = schema or S.customer_schema()
    if lines:
        records = spark.read.schema(schema).json(path)
        if records.isEmpty():
            raise ValueError("the source returned 0 records")
        return records
    env = T.StructType([T.StructField("count", T.LongType()),
                        T.StructField(field, T.ArrayType(schema))])
    raw = spark.read.option("multiLine", True).schema(env).json(path)
    if not raw.filter(F.col(field).isNotNull()).isEmpty():          # an envelope
        records = raw.select(F.inline(field))
    else:                                                           # a bare list of records
        records = spark.read.option("multiLine", True).schema(schema).json(path)
    if records.isEmpty():
        raise ValueError("the source returned 0 records")
    return records


# -- A8 / F2: newest log rows --------------------------------------------------------

LOG_VIEW = ["inference_id", "customer_id", "churn_probability", "predicted_churn", "model_version", "created_at"]


def recent_logs(logs: DataFrame, limit: int = 200) -> DataFrame:
    """Newest first; a top-k (TakeOrderedAndProject), never a full sort."""
    return logs.select(*LOG_VIEW).orderBy(F.desc("created_at"), F.desc("inference_id")).limit(limit)
