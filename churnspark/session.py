"""Session helpers.

The library never fixes a master or a cluster path: on a cluster the session comes
from the launcher (spark-submit / notebook) and this module only fills in defaults
that are still unset.  Tests and the bench ask for ``local[N]`` explicitly.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Defaults that matter for correctness (UTC, ANSI-safe reads) and for scale (AQE).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Parquet timestamps without zone are read as TIMESTAMP_NTZ by Spark 4; keep them so.
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    # checkpoint files of numbered frames are removed once nothing references them
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app_name: str = "churnspark",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Return the active session, creating one with churnspark defaults if needed."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("CHURNSPARK_DRIVER_MEMORY", "16g"))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    # getOrCreate on an existing session ignores builder conf for static keys; SQL confs can still be set.
    for k, v in _DEFAULTS.items():
        if k.startswith("spark.sql.") and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when it is unset (local tests) a fallback is set: the given folder or a fresh
    temporary one.  On a cluster the setting must be present; a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a shared folder (HDFS/S3/...) "
                           "for checkpoints; a machine-local folder does not survive lost executors")
    target = conf_dir or fallback or tempfile.mkdtemp(prefix="churnspark-ckpt-")
    sc.setCheckpointDir(target)
    return sc.getCheckpointDir() or target


def cut_lineage(df, spark: SparkSession | None = None):
    """Reliable checkpoint (never ``localCheckpoint``): materialises ``df`` in the shared folder."""
    spark = spark or df.sparkSession
    checkpoint_dir(spark)
    return df.checkpoint(eager=True)
