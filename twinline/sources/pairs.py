"""Reading parallel pairs: the base corpus and registered extra sources."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.pairs import cap_pairs, drop_empty_pairs, strip_pairs
from ..plans.sizing import spread

SPLITS = ("train", "validation", "test")


def read_pairs(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    source: str | Column = "src",
    target: str | Column = "tgt",
) -> DataFrame:
    """The base corpus as ``(pair_id, split, src, tgt)``; text is left unstripped.

    ``split`` may be a partition column of the path; a filter on it then prunes.
    """
    return spread(spark.read.format(fmt).load(path)).select(
        F.col("pair_id").cast("long").alias("pair_id"), "split", _as(source, "src"), _as(target, "tgt")
    )


@dataclass(frozen=True)
class ExtraSource:
    """Where an extra corpus lies and how its two sentences are taken out of a record.

    ``source`` and ``target`` are SQL expressions or Columns over the stored record;
    only the fields that they name are read.
    """

    path: str
    key: str | Column = "pair_id"
    source: str | Column = "translation.en"
    target: str | Column = "translation.de"
    fmt: str = "parquet"
    split: str | None = None


def read_extra(
    spark: SparkSession,
    registry: Mapping[str, ExtraSource],
    name: str,
    cap: int | None = None,
) -> DataFrame:
    """Pairs of one registered source: stripped, empties dropped, then capped."""
    if name not in registry:
        raise ValueError(f"unknown extra source {name!r}; known: {sorted(registry)}")
    entry = registry[name]
    raw = spark.read.format(entry.fmt).load(entry.path)
    if entry.split is not None:
        raw = raw.filter(F.col("split") == entry.split)
    pairs = spread(raw).select(
        _as(entry.key, "pair_id"),
        F.lit("train").alias("split"),
        _as(entry.source, "src"),
        _as(entry.target, "tgt"),
    )
    return cap_pairs(drop_empty_pairs(strip_pairs(pairs)), cap)


def _as(column: str | Column, name: str) -> Column:
    return (F.expr(column) if isinstance(column, str) else column).alias(name)
