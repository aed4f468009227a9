"""Batches of encoded pairs: assignment, padding, masks, token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import ids as I
from ..plans.joins import join_on_groups
from ..plans.row_index import with_row_index
from ..plans.sizing import small_side
from ..plans.stages import write_stage


def assign_batches(
    pairs: DataFrame,
    batch_size: int,
    seed: int | str = 0,
    shuffled_splits: Sequence[str] = ("train",),
    drop_last_splits: Sequence[str] = ("train",),
    lengths_of: Sequence[str] = (),
) -> DataFrame:
    """Add ``batch_id`` and ``pos`` within each split.

    Shuffled splits are ordered by a hash of the seed and ``pair_id`` (repeatable on
    any cluster), the others by ``pair_id``. Where pairs carry an ``origin``, it is part of
    the hash and of the order, since two origins may use the same ids. The last partial
    batch is dropped for the splits that ask for it; :func:`dropped_rows` tells how many rows.

    Only ids (and the sizes of the arrays ``lengths_of``) are numbered and sorted; the whole
    rows are written once, as they come, and move once, to meet their places. ``lengths_of``
    adds ``longest_<column>``, the size of the longest array of the batch, which
    :func:`pad_batch` then need not look for. A split, origin and id that occur twice raise an
    error when the result is computed.
    """
    identity = ["origin", "pair_id"] if "origin" in pairs.columns else ["pair_id"]
    rows, _ = write_stage(pairs, "batch-rows")
    shuffled = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in identity]))
    sizes = {f"_size_{c}": F.size(c) for c in lengths_of}
    narrow = rows.select(
        "split", *identity, F.when(F.col("split").isin(*shuffled_splits), shuffled).otherwise(F.lit("")).alias("_mix"),
        *[size.alias(name) for name, size in sizes.items()],
    )
    placed = with_row_index(narrow, ["_mix", *identity], within=["split"], out="_idx", total="_total").drop("_mix")
    full = F.floor(F.col("_total") / batch_size) * batch_size
    kept = placed.filter(~F.col("split").isin(*drop_last_splits) | (F.col("_idx") < full)).select(
        "split", *identity, *sizes, F.floor(F.col("_idx") / batch_size).alias("batch_id"), (F.col("_idx") % batch_size).cast("int").alias("pos")
    )
    longest = [f"longest_{c}" for c in lengths_of]
    if lengths_of:
        most = kept.groupBy(*BATCH_KEY).agg(*[F.max(f"_size_{c}").alias(f"longest_{c}") for c in lengths_of])
        kept = join_on_groups(kept, most, BATCH_KEY)
    place = F.struct("batch_id", "pos", *longest)
    once = kept.groupBy("split", *identity).agg(F.min(place).alias("_place"), F.count("*").alias("_n"))
    fault = F.concat(F.lit("pair_id is not unique: "), F.coalesce(F.col("pair_id").cast("string"), F.lit("null")))
    sure = F.when(F.col("_n") == 1, F.col("_place")).otherwise(F.raise_error(fault).cast(once.schema["_place"].dataType))
    places = small_side(once.select("split", *identity, sure.alias("_place")), "batch-places")
    joined = join_on_groups(rows, places, ["split", *identity])
    return joined.select(*pairs.columns, "_place.*")


def dropped_rows(pairs: DataFrame, batch_size: int, drop_last_splits: Sequence[str] = ("train",)) -> DataFrame:
    """Rows per split that the last partial batch of :func:`assign_batches` takes away: ``(split, n_dropped)``."""
    counted = pairs.groupBy("split").agg(F.count("*").alias("n"))
    return counted.select("split", F.when(F.col("split").isin(*drop_last_splits), F.col("n") % batch_size).otherwise(F.lit(0)).alias("n_dropped"))


BATCH_KEY = ("split", "batch_id")


def pad_batch(
    pairs: DataFrame,
    columns: Sequence[str] = ("src_ids", "tgt_ids"),
    batch: Sequence[str] = BATCH_KEY,
) -> DataFrame:
    """Pad the id columns to the longest row of their batch (a batch is small by design).

    Where ``longest_<column>`` is there (see :func:`assign_batches`) it is used and dropped, and
    no row moves.
    """
    known = {c: f"longest_{c}" for c in columns}
    if not all(name in pairs.columns for name in known.values()):
        rows = Window.partitionBy(*batch)
        pairs = pairs.withColumns({name: F.max(F.size(c)).over(rows) for c, name in known.items()})
    return pairs.withColumns({c: I.pad_ids(F.col(c), F.col(name)) for c, name in known.items()}).drop(*known.values())


def with_decoder_sides(padded: DataFrame, target: str = "tgt_ids") -> DataFrame:
    """Add ``tgt_in`` and ``tgt_out``, the padded target without its last and first id."""
    return padded.withColumns(
        {"tgt_in": I.decoder_input(F.col(target)), "tgt_out": I.decoder_target(F.col(target))}
    )


def with_masks(batches: DataFrame) -> DataFrame:
    """Add ``src_mask`` and ``tgt_mask`` (True means masked out)."""
    return batches.withColumns(
        {"src_mask": I.source_mask(F.col("src_ids")), "tgt_mask": I.target_mask(F.col("tgt_in"))}
    )


def build_batches(pairs: DataFrame, batch_size: int, seed: int | str = 0) -> DataFrame:
    """Encoded pairs to padded training batches with decoder sides and masks."""
    batches = assign_batches(pairs, batch_size, seed, lengths_of=("src_ids", "tgt_ids"))
    return with_masks(with_decoder_sides(pad_batch(batches)))


def batch_token_count(batches: DataFrame, batch: Sequence[str] = BATCH_KEY) -> DataFrame:
    """Non-PAD ids of ``tgt_out`` per batch."""
    return batches.groupBy(*batch).agg(
        F.sum(I.real_token_count(F.col("tgt_out"))).alias("n_tokens")
    )
