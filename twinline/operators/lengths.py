"""Statistics of encoded lengths and of tokens per word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.stages import write_stage


def token_length_stats(lengths: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Mean, median, 95th percentile (both exact, linear) and maximum.

    ``percentile`` keeps a count per distinct value, so what is shuffled is bounded
    by the number of different lengths.
    """
    return lengths.agg(
        F.avg(length).alias("mean_len"),
        F.percentile(length, 0.5).alias("median_len"),
        F.percentile(length, 0.95).alias("p95_len"),
        F.max(length).alias("max_len"),
    )


def first_lines(lines: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """A sample for a length report: the first ``n`` lines."""
    return lines.orderBy(*order_by).limit(n)


def token_length_histogram(lengths: DataFrame, length: str = "n_tokens", bins: int = 40) -> DataFrame:
    """Equal-width bins over [min, max] as ``(bin, lo, hi, n)``; the last bin is closed.

    Rows are first counted per length and that table, no longer than the number of
    different lengths, is written once; bounds and bins come from it. With a single
    length the range is widened by one half on both sides; with no rows it is [0, 1].
    """
    counted, _ = write_stage(
        lengths.groupBy(F.col(length).cast("double").alias("x")).agg(F.count("*").alias("n")),
        "length-counts",
    )
    lo, hi = counted.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        lo, hi = 0.0, 1.0
    elif lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    place = F.floor((F.col("x") - lo) / (hi - lo) * bins)
    filled = counted.groupBy(F.least(place, F.lit(bins - 1)).alias("bin")).agg(F.sum("n").alias("n"))
    width = (hi - lo) / bins
    return lengths.sparkSession.range(bins).withColumnRenamed("id", "bin").join(filled, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def over_max_len_share(lengths: DataFrame, length: str = "n_tokens", max_len: int = 128) -> DataFrame:
    """Share of lines longer than ``max_len``."""
    return lengths.agg(F.avg((F.col(length) > max_len).cast("int")).alias("over_share"))


def pair_token_counts(pairs: DataFrame) -> DataFrame:
    """Token counts of both sides per pair."""
    return pairs.select(
        "pair_id", F.size("src_ids").alias("src_tokens"), F.size("tgt_ids").alias("tgt_tokens")
    )


def word_fertility(dictionary: DataFrame) -> DataFrame:
    """Tokens per word, from a dictionary ``(word, n, ids)``."""
    return dictionary.select("word", "n", F.size("ids").alias("n_tokens"))


def mean_fertility(dictionary: DataFrame) -> DataFrame:
    """Corpus average of tokens per word, each word weighted by its count."""
    weighted: Column = F.sum(F.col("n") * F.size("ids"))
    return dictionary.agg((weighted / F.sum("n")).alias("tokens_per_word"), F.sum("n").alias("n_words"))
