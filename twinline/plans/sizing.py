"""Broadcast only what has been measured and found small."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .stages import stage_bytes, write_stage

BROADCAST_BYTES = 16 << 20


def _width(field: T.StructField) -> Column:
    name = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 8
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0)) + 8
    return F.lit(8)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the rows, summed inside each task before anything is sent."""
    width = sum((_width(f) for f in df.schema.fields), F.lit(8))
    return df.agg(F.sum(width.cast("long"))).first()[0] or 0


def broadcast_if_small(df: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast when the rows of ``df`` take at most ``max_bytes``.

    Otherwise the DataFrame is returned as it is and the join shuffles, with AQE
    free to split skewed partitions.
    """
    return F.broadcast(df) if measured_bytes(df) <= max_bytes else df


def small_side(df: DataFrame, name: str, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A derived join side, computed once into a stage table and then checked by its file sizes.

    Without the stage, measuring it and joining it would each run what it derives from.
    """
    stage, path = write_stage(df, name)
    return F.broadcast(stage) if stage_bytes(df.sparkSession, path) <= max_bytes else stage


def spread(df: DataFrame) -> DataFrame:
    """Use all cores when a scan yields fewer tasks than there are cores.

    Few large unsplittable files, or one small file, would otherwise leave the rest
    of the cluster idle through costly text work. A scan that already has enough
    tasks is returned unchanged, so large inputs are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
