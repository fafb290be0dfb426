"""SparkSession factory: UTC, adaptive execution, shuffle partitions sized by the caller."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "gyrelake", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings that every query here assumes.

    On a cluster ``master`` and the shuffle partitions come from spark-submit; they are set
    here only when given (tests, the bench).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("GYRELAKE_DRIVER_MEMORY", "6g"),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    spark = builder.config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The folder for tables between two jobs that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A local session that names none gets one of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="gyrelake-scratch-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")
