"""Host-level quality rules: failures by host, shrunk by an empirical beta prior, joined back.

DataFrame functions only. A host (the ``source`` column) with few documents says little
about itself, so its failure rate is drawn towards the rate of all hosts: the prior's mean
and strength are fitted by moments to the rates of all hosts, and a host fails when its
posterior mean is above ``max_rate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import small_side
from ..plans.stages import write_stage

SPACE = "[ \\x09-\\x0D]+"
WORD = "[^ \\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
FALLBACK_STRENGTH = 100.0  # documents' worth of prior when the rates of all hosts are equal


def base_measures(text: Column) -> dict[str, Column]:
    """Counts over the text and its ``_words``."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return {
        "n_words": F.size("_words").cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five base counts and ``base_failed`` to every row; null counts as the empty text.

    Windows are compared by 64-bit hashes inside one text. A text without repeated windows,
    the usual case, is done after one pass; otherwise the windows are sorted with their places.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    cut = docs.withColumn("_words", F.array_remove(F.split(text, SPACE), ""))
    cut = cut.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    count = F.size("_hashes") - WINDOW + 1
    at = lambda i: F.xxhash64(*[F.get(F.col("_hashes"), i + j) for j in range(WINDOW)])
    cut = cut.withColumn("_windows", F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<bigint>")))
    counted = cut.select(*docs.columns, "_windows", *[c.alias(n) for n, c in base_measures(text).items()])
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    placed = F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    counted = counted.withColumn("_placed", placed).drop("_windows")
    twin = lambda x, i: (F.get(F.col("_placed"), i + 1)["h"] == x["h"]) | ((i > 0) & (F.get(F.col("_placed"), F.greatest(i - 1, F.lit(0)))["h"] == x["h"]))
    starts = F.sort_array(F.transform(F.filter("_placed", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))
    counted = counted.withColumn("_starts", starts).drop("_placed")
    step = lambda acc, p: F.struct(
        (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("long").alias("n"), (p + WINDOW).alias("end")
    )
    covered = F.aggregate("_starts", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    counted = counted.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")
    return counted.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def host_verdicts(measured: DataFrame, max_rate: float, host_col: str = "source") -> DataFrame:
    """``host, host_docs, host_failures, host_rate, host_failed``: one row per host, null being one of them."""
    hosts = measured.groupBy(F.col(host_col).alias("host")).agg(
        F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failures")
    )
    rate = F.col("host_failures") / F.col("host_docs")
    prior = hosts.agg(
        (F.sum("host_failures") / F.sum("host_docs")).alias("mean"), F.var_pop(rate).alias("var"),
    ).first()  # two numbers
    mean, var = (prior["mean"] or 0.0), (prior["var"] or 0.0)
    strength = max(1.0, mean * (1 - mean) / var - 1) if var > 1e-12 else FALLBACK_STRENGTH
    posterior = (F.col("host_failures") + strength * mean) / (F.col("host_docs") + strength)
    return hosts.select("*", posterior.alias("host_rate")).withColumn("host_failed", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, max_rate: float = 0.5, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row: the id, the base counts, ``base_failed``, the host's shrunk rate and ``kept``.

    A document is kept when it passes the base rules and its host does not fail. ``max_rate``
    is high on purpose: hosts go when most of their documents would, not for a few bad ones.
    Null hosts form one host. Rows that repeat are counted and answered each. Empty tables
    give an empty result.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("source"))
    measured, _ = write_stage(measure(narrow).drop("text"), "base-measures")
    hosts = small_side(host_verdicts(measured, max_rate), "hosts")
    joined = measured.join(hosts, F.col("source").eqNullSafe(F.col("host")))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.round("host_rate", 6).alias("host_rate"), (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
