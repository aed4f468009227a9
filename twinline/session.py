"""Session helper for local runs; on a cluster bring your own session."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def with_checkpoint_dir(spark: SparkSession) -> SparkSession:
    """Set ``spark.checkpoint.dir`` to a new folder on a local master that has none.

    A cluster must name its shared folder itself; there an unset one is an error.
    """
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="twinline-"))
    return spark


def local_session(cores: int | str = "*", app: str = "twinline", **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        # Small tables often feed costly expressions here, so keep their parts small too.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return with_checkpoint_dir(spark)
