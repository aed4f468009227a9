"""Cleaning, merging and counting sentence pairs ``(pair_id, split, src, tgt)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.text import strip_text
from ..plans.row_index import with_row_index
from ..plans.selection import first_rows


def strip_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"src": strip_text(F.col("src")), "tgt": strip_text(F.col("tgt"))})


def drop_empty_pairs(pairs: DataFrame) -> DataFrame:
    """Keep pairs whose two sides are non-empty (strip first)."""
    return pairs.filter((F.length("src") > 0) & (F.length("tgt") > 0))


def cap_pairs(pairs: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` pairs by ``pair_id``; ``None`` or 0 keeps all.

    Integer ids are cut by counting alone (see :func:`first_rows`): the corpus is neither
    sorted nor written, and exactly ``n`` rows stay even where ids repeat. Ids of other types
    are numbered, the key column alone; pairs that share the last of them all stay. A null id
    comes first.
    """
    if not n:
        return pairs
    if isinstance(pairs.schema["pair_id"].dataType, T.IntegralType):
        return first_rows(pairs, "pair_id", n)
    last = with_row_index(pairs.select("pair_id"), ["pair_id"], out="_cap_idx").filter(F.col("_cap_idx") == n - 1).first()
    if last is None:
        return pairs
    missing = F.col("pair_id").isNull()
    return pairs.filter(missing if last.pair_id is None else missing | (F.col("pair_id") <= last.pair_id))


def merge_train_extra(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Append the extra pairs to the train split; no duplicates are removed."""
    return base.withColumn("origin", F.lit("base")).unionByName(
        extra.withColumn("split", F.lit("train")).withColumn("origin", F.lit("extra"))
    )


def interleave_lines(pairs: DataFrame, splits: Sequence[str] = ("train",)) -> DataFrame:
    """Two stripped lines per pair, source first, with the columns that order them.

    ``pairs`` may carry ``origin``; base pairs of the chosen splits come first,
    split by split, then the extra pairs.
    """
    if "origin" not in pairs.columns:
        pairs = pairs.withColumn("origin", F.lit("base"))
    rank = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split")).cast("int")
    part = F.when(F.col("origin") == "extra", F.lit(len(splits) + 1)).otherwise(rank)
    sides = F.array(
        F.struct(F.lit(0).alias("side"), strip_text(F.col("src")).alias("line")),
        F.struct(F.lit(1).alias("side"), strip_text(F.col("tgt")).alias("line")),
    )
    return (
        pairs.filter((F.col("origin") == "extra") | F.col("split").isin(*splits))
        .select(part.alias("part"), "pair_id", F.inline(sides))
    )


LINE_ORDER = ("part", "pair_id", "side")


def split_counts(pairs: DataFrame) -> DataFrame:
    """Pairs per split and origin, with a subtotal row (origin ``all``) per split."""
    if "origin" not in pairs.columns:
        pairs = pairs.withColumn("origin", F.lit("base"))
    cells = pairs.groupBy("split", "origin").agg(F.count("*").alias("n"))
    both = cells.select("split", F.explode(F.array("origin", F.lit("all"))).alias("origin"), "n")
    return both.groupBy("split", "origin").agg(F.sum("n").alias("n_pairs"))


def batch_counts(
    pairs: DataFrame, batch_size: int, drop_last_splits: Sequence[str] = ("train",)
) -> DataFrame:
    """Batches per split: the last partial batch counts except where it is dropped."""
    full = F.floor(F.col("n_pairs") / batch_size)
    return (
        pairs.groupBy("split")
        .agg(F.count("*").alias("n_pairs"))
        .withColumn(
            "n_batches",
            F.when(F.col("split").isin(*drop_last_splits), full).otherwise(
                F.ceil(F.col("n_pairs") / batch_size)
            ),
        )
    )
