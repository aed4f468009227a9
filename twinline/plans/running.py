"""Running (prefix) aggregates that do not put a whole group into one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .stages import write_stage

_AGGREGATES = {"sum": F.sum, "max": F.max}
_COMBINE = {
    "sum": lambda before, here: F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0)),
    "max": lambda before, here: F.greatest(before, here),
}


def in_cells(df: DataFrame, keys: Sequence[str], order_by: str, parts: int | None = None) -> DataFrame:
    """Add ``_cell``: the group and the range of ``order_by`` that a row belongs to.

    Ranges are the partitions of a range partitioning on group and order, so they follow
    the number of rows, whatever the unit and spread of the order column, and rows that tie
    stay together. A group has at most one cell per partition. The placed rows are written
    once, because the bounds come from a sample that a second evaluation may draw anew.

    The cell is one struct: never null itself, and null fields equal each other. Windows,
    aggregates and joins on this one column share a single shuffle.
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, order_by)
    placed, _ = write_stage(ranged.withColumn("_part", F.spark_partition_id()), "ordered-parts")
    return placed.withColumn("_cell", F.struct(*keys, "_part")).drop("_part")


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order_by: str,
    columns: Mapping[str, tuple[str, Column]],
    inclusive: bool = True,
    parts: int | None = None,
) -> DataFrame:
    """Add running ``sum`` or ``max`` columns over an order column.

    ``columns`` maps an output name to ``(kind, expression)``. Windows run inside the cells
    of ``in_cells``; the cell totals (at most a row per group and partition) carry the earlier
    cells over. ``parts`` sets the number of partitions; Spark chooses it otherwise.
    """
    names = list(columns)
    base = in_cells(df, keys, order_by, parts)
    for name, (_, expr) in columns.items():
        base = base.withColumn(f"_v_{name}", expr)
    frame = (
        Window.partitionBy("_cell")
        .orderBy(order_by)
        .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    totals = base.groupBy("_cell").agg(
        *[_AGGREGATES[columns[name][0]](f"_v_{name}").alias(f"_t_{name}") for name in names]
    )
    before = (
        Window.partitionBy(*[F.col("_cell")[k] for k in keys])
        .orderBy(F.col("_cell")["_part"])
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = totals.select(
        "_cell",
        *[_AGGREGATES[columns[name][0]](f"_t_{name}").over(before).alias(f"_b_{name}") for name in names],
    )
    local = base.select(
        *df.columns,
        "_cell",
        *[_AGGREGATES[columns[name][0]](f"_v_{name}").over(frame).alias(f"_l_{name}") for name in names],
    )
    return local.join(carried, "_cell").select(
        *df.columns,
        *[
            _COMBINE[columns[name][0]](F.col(f"_b_{name}"), F.col(f"_l_{name}")).alias(name)
            for name in names
        ],
    )
