"""Session construction and the shared checkpoint folder.

On a cluster the session comes from the platform; ``configure`` only fills in
what is unset.  ``local_session`` is for tests and the bench.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  AQE re-plans joins at run
# time from measured sizes (the only broadcast decision we trust for tables
# that grow), coalesces small shuffle partitions and splits skewed ones.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.parquet.compression.codec": "snappy",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply package defaults that the session has not set itself."""
    conf = spark.conf
    for key, value in _DEFAULTS.items():
        if conf.get(key, None) in (None, ""):
            conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster names it; only a local session without one gets a scratch
    folder, so that tests can cut lineage the same way production does.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        # ``local`` and ``local[...]`` share one machine; ``local-cluster[...]`` does not count
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="ledgerlake-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "ledgerlake", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("LEDGERLAKE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        # PySpark 4 records the Python call site of every column call for
        # error messages: several driver round trips each.  Batch jobs with
        # large plans build noticeably faster without it.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in {**_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)
