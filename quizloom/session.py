"""Session construction and cluster-level settings."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "quizloom", shuffle_partitions: int | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings every plan here assumes.

    AQE is on so shuffle partitions coalesce at runtime and skewed join
    partitions are split; the session time zone is UTC so epoch arithmetic on
    timestamps agrees with the SQL oracle.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        builder.config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus) * 2))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # The question plans join on keys computed through deep projections; the
        # dynamic-partition-pruning rule walks that lineage exponentially (47 s of
        # planning for one plan) and none of these joins hit a partitioned table.
        .config("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
        .config("spark.driver.memory", os.environ.get("QUIZLOOM_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the setting names a shared file system folder and is used as
    is.  Only a local master, whose tasks share the driver's disk, gets a scratch
    folder when it is unset (removed when the process ends); a cluster must set it.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="quizloom-ckpt-")
        atexit.register(shutil.rmtree, conf_dir, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    spark.sparkContext.setCheckpointDir(conf_dir)
    return conf_dir


# Runtime SQL settings every plan here assumes; applied to sessions built elsewhere too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "false",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply ``RUNTIME_CONF`` and make sure a checkpoint folder is set."""
    for k, v in RUNTIME_CONF.items():
        spark.conf.set(k, v)
    checkpoint_dir(spark)
    return spark
