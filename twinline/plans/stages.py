"""Stage tables: cut a plan's lineage by writing it to the shared folder.

A stage survives the loss of any executor because it lives in the folder named by
``spark.checkpoint.dir``; nothing is kept on an executor's own disk. Parquet is
used rather than ``DataFrame.checkpoint`` so that later reads prune columns, push
filters and know their size (which lets the planner pick broadcast joins).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder for stage tables, as the session names it; every executor must reach it."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    return configured


def run_root(spark: SparkSession) -> str:
    """The folder that holds all stage tables of this application."""
    return f"{shared_root(spark)}/twinline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once and return the table read back, with its path."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)  # hashes and ranks shrink by entropy only
    return spark.read.schema(df.schema).parquet(path), path


def write_bucketed(df: DataFrame, name: str, key: str) -> tuple[DataFrame, str]:
    """Write ``df`` once, bucketed by ``key`` in as many buckets as a shuffle has parts; the table and its name.

    Joins and windows on the key then read it as it lies. Remove it with :func:`drop_bucketed`.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(parts, key)  # so that every bucket is one file
    writer = placed.write.bucketBy(parts, key).sortBy(key).option("compression", "zstd").option("path", f"{run_root(spark)}/{table}")
    writer.format("parquet").saveAsTable(table)
    return spark.table(table), table


def drop_bucketed(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_stage(spark, f"{run_root(spark)}/{table}")


def stage_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files of a stage table."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getLength()


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path)


def drop_run(spark: SparkSession) -> None:
    """Remove every stage table of this application; call it when no DataFrame needs them."""
    drop_stage(spark, run_root(spark))


def drop_stage(spark: SparkSession, path: str) -> None:
    """Remove a stage table that this run wrote and no longer needs."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)
