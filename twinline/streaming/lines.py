"""Unbounded lines: strip, skip blanks, apply a batch operator, append to a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import strip_text


def stream_map_lines(
    spark: SparkSession,
    source: str,
    sink: str,
    checkpoint: str,
    operator: Callable[[DataFrame], DataFrame],
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
) -> StreamingQuery:
    """Start a query that maps new text lines of folder ``source`` into parquet under ``sink``.

    ``operator`` is any batch operator over ``(line)``. Nothing is kept between
    micro-batches, so there is no state to grow. A micro-batch overwrites its own
    folder, so a repeated one leaves each line once.
    """
    reader = spark.readStream
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(source).select(strip_text(F.col("value")).alias("line"))

    def write(batch: DataFrame, batch_id: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{sink}/micro_batch={batch_id}")

    writer = (
        lines.filter(F.length("line") > 0)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
