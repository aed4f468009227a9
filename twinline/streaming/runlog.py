"""Running weighted loss of a growing batch log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.runlog import token_weighted_loss
from ..plans.stages import drop_stage, path_exists

_KEPT = 2  # versions that stay, so that a reader of the last but one is not cut off


def _versions(spark: SparkSession, sink: str) -> list[int]:
    """Micro-batches whose version of the current values is whole, oldest first."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(sink)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    numbers = sorted(int(name.removeprefix("version=")) for name in names if name.startswith("version="))
    return [n for n in numbers if path_exists(spark, f"{sink}/version={n}/_SUCCESS")]


def stream_running_loss(
    batch_log: DataFrame, sink: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Start a query over a streaming ``batch_log`` that keeps the current values of every epoch.

    State is one row per epoch, and so is what a micro-batch writes: the version before it with
    the changed epochs put in their place. Older versions go. A micro-batch that is run again
    starts from the same version and overwrites its own. Read with :func:`latest_loss`.
    """

    def write(changed: DataFrame, batch_id: int) -> None:
        spark = changed.sparkSession
        earlier = [n for n in _versions(spark, sink) if n < batch_id]
        rows = changed.withColumn("_age", F.lit(0))
        if earlier:
            rows = rows.unionByName(spark.read.schema(changed.schema).parquet(f"{sink}/version={earlier[-1]}").withColumn("_age", F.lit(1)))
        values = F.struct(*[c for c in changed.columns if c != "epoch"])
        merged = rows.groupBy("epoch").agg(F.min_by(values, "_age").alias("v")).select("epoch", "v.*")
        merged.select(*changed.columns).write.mode("overwrite").parquet(f"{sink}/version={batch_id}")
        for n in earlier[: 1 - _KEPT]:
            drop_stage(spark, f"{sink}/version={n}")

    writer = (
        token_weighted_loss(batch_log)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def latest_loss(spark: SparkSession, sink: str) -> DataFrame:
    """The current values, one row per epoch however many micro-batches ran; FileNotFoundError before the first."""
    versions = _versions(spark, sink)
    if not versions:
        raise FileNotFoundError(f"no running loss at {sink!r} yet")
    return spark.read.parquet(f"{sink}/version={versions[-1]}")
