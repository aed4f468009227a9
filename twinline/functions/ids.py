"""Functions on arrays of token ids."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import EOS, PAD, SOS


def _ints(*values: int) -> Column:
    return F.array(*[F.lit(v) for v in values])


def wrap_special(ids: Column) -> Column:
    """``[SOS] ids [EOS]``."""
    return F.concat(_ints(SOS), ids, _ints(EOS))


def wrap_special_pair(first: Column, second: Column) -> Column:
    """``[SOS] first [EOS] [SOS] second [EOS]``."""
    return F.concat(wrap_special(first), wrap_special(second))


def truncate_ids(ids: Column, max_len: int) -> Column:
    """Longer than ``max_len``: the first ``max_len - 1`` ids and EOS."""
    return F.when(
        F.size(ids) > max_len, F.concat(F.slice(ids, 1, max_len - 1), _ints(EOS))
    ).otherwise(ids)


def strip_special_ids(ids: Column) -> Column:
    """Drop PAD, UNK, SOS and EOS."""
    return F.filter(ids, lambda x: x > EOS)


def cut_at_eos(ids: Column) -> Column:
    """The ids before the first EOS; all of them if there is none."""
    at = F.array_position(ids, EOS)
    return F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids)


def decoder_input(padded: Column) -> Column:
    """All ids but the last; apply after padding."""
    return F.slice(padded, F.lit(1), F.greatest(F.size(padded) - 1, F.lit(0)))


def decoder_target(padded: Column) -> Column:
    """All ids but the first; apply after padding."""
    return F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))


def pad_ids(ids: Column, length: Column) -> Column:
    """Fill with PAD up to ``length``."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), length - F.size(ids)))


def attention_mask(ids: Column) -> Column:
    """1 for a real token, 0 for PAD."""
    return F.transform(ids, lambda x: (x != PAD).cast("int"))


def source_mask(ids: Column) -> Column:
    """True where the id is PAD."""
    return F.transform(ids, lambda x: x == PAD)


def target_mask(ids: Column) -> Column:
    """Square mask, True where the position is later than the row's or is PAD."""
    return F.transform(
        ids, lambda _, i: F.transform(ids, lambda x, j: (j > i) | (x == PAD))
    )


def real_token_count(ids: Column) -> Column:
    """How many ids are not PAD."""
    return F.size(F.filter(ids, lambda x: x != PAD))
