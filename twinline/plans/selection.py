"""The n-th smallest key of a table, found by counting: nothing is sorted, moved or written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PARTS = 4096  # ranges that a pass counts; three passes narrow ids up to 6 * 10^10 to one value


def nth_smallest(df: DataFrame, key: Column, n: int) -> tuple[int, int] | None:
    """The n-th smallest (from 1) of an integer key and how many keys are smaller; None with fewer keys.

    A pass counts the keys in ``PARTS`` even ranges (at most so many rows come back) and goes
    on with the range that holds the n-th, until that is a single value. Null keys do not count.
    """
    low, high, total = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if total < n:
        return None
    smaller = 0
    while low < high:
        width = (high - low) // PARTS + 1
        inside = df.filter((key >= low) & (key <= high))
        place = F.floor((key.cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        if high - low < 1 << 52:  # doubles are exact here, and cheaper
            place = F.floor((key - low) / width)
        counts = sorted((row.place, row["count"]) for row in inside.groupBy(place.cast("long").alias("place")).count().collect())
        for at, count in counts:
            if smaller + count >= n:
                break
            smaller += count
        low, high = low + at * width, min(high, low + (at + 1) * width - 1)
    return low, smaller


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """Exactly the first ``n`` rows by an integer column, null keys first; all rows if there are fewer.

    Rows that share the last key are told apart by a hash of the whole row, found in the same
    way; of equal rows as many as are wanted are made from one, since they do not differ.
    """
    nulls = df.filter(F.col(key).isNull()).count()
    last = None
    if n > nulls:
        last = nth_smallest(df, F.col(key).cast("long"), n - nulls)
        if last is None:
            return df
    missing = F.col(key).isNull()
    tied = missing if last is None else F.col(key) == last[0]
    before = F.lit(False) if last is None else missing | (F.col(key) < last[0])
    wanted = n if last is None else n - nulls - last[1]
    mix = F.shiftrightunsigned(F.xxhash64(*[F.col(c) for c in df.columns]), 2)
    rows = df.filter(tied)
    cut, smaller = nth_smallest(rows, mix, wanted)
    sure = df.filter(before | (tied & (mix < cut)))
    equal = rows.filter(mix == cut)
    copies = wanted - smaller
    if equal.count() == copies:
        return df.filter(before | (tied & (mix <= cut)))
    one = equal.limit(1)
    return sure.unionByName(one.select("*", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy")).drop("_copy"))
