"""Numbers that only one writer can take: table versions and ranges of log ids.

A claim is a one-row dataset in a folder of its own, ``n=<number>/try=0``, written with
``errorifexists``: of two writers that want the same number the second one raises ``Taken``.  What
the number stands for (a data folder, a range of ids) is written before or after it under names
of its own, so an unclaimed leftover is never read and never in the way.

A writer lost while it writes the row itself leaves a folder without a row.  ``settle`` waits for
the row and, if none comes, makes the number void (``try=1``); a writer that was only slow finds
the void mark when it checks its claim and raises ``Taken``.  Void numbers are skipped.
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Taken(RuntimeError):
    """The number belongs to another writer, or is void."""


def read_if_there(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame | None:
    """None only when the path does not exist; any other failure is raised, since taking an
    unreadable folder for an empty one would lose what it holds."""
    try:
        return spark.read.schema(schema).format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _all(spark: SparkSession, root: str, schema: str) -> DataFrame:
    full = f"{schema}, n int, try int"
    found = read_if_there(spark, root, full)
    return spark.createDataFrame([], full) if found is None else found


def claims(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """The valid claims: ``schema`` and their number ``n``."""
    found = _all(spark, root, schema)
    void = found.filter("try > 0").select("n").distinct()
    return found.filter("try = 0").join(void, "n", "left_anti").drop("try")


def is_void(spark: SparkSession, root: str, schema: str, number: int) -> bool:
    return not _all(spark, root, schema).filter((F.col("n") == number) & (F.col("try") > 0)).isEmpty()


def _write(spark: SparkSession, path: str, values: tuple, schema: str) -> None:
    try:
        spark.createDataFrame([values], schema).coalesce(1).write.mode("errorifexists").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise Taken(path) from e
        raise


def claim(spark: SparkSession, root: str, number: int, values: tuple, schema: str) -> None:
    """Take ``number`` for ``values`` or raise ``Taken``."""
    _write(spark, f"{root}/n={number}/try=0", values, schema)
    if is_void(spark, root, schema, number):
        raise Taken(f"{root}: number {number} was made void")


def settle(spark: SparkSession, root: str, number: int, schema: str, wait_seconds: float) -> bool:
    """After ``Taken``: true if the number has an owner, false if it is void from now on."""
    end = time.monotonic() + wait_seconds
    while True:
        found = _all(spark, root, schema).filter(F.col("n") == number).select("try").collect()
        if any(r["try"] > 0 for r in found):
            return False
        if found:
            return True
        if time.monotonic() >= end:
            break
        time.sleep(min(0.5, wait_seconds))
    try:
        _write(spark, f"{root}/n={number}/try=1", (None,) * len(schema.split(",")), schema)
    except Taken:
        pass                                # another waiting writer has just done so
    return False
