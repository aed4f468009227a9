"""Equi-join that keeps rows whose key is null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F


def join_on_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join of rows with one row per group, null keys matching null keys.

    Grouping treats null as a value, so joining a group's figures back must as well, or
    the rows of that group would vanish.
    """
    renamed = groups.withColumnsRenamed({k: f"_group_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_group_{k}")) for k in keys])
    return rows.join(renamed, same).drop(*[f"_group_{k}" for k in keys])
