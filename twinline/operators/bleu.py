"""Corpus BLEU: scoring tokens, clipped n-gram matches, one reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import bleu_tokenize_13a

MAX_ORDER = 4


def align_hyp_ref(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """``(sent_id, hyp, ref)`` for every reference; a missing or null hypothesis is empty.

    A hypothesis without a reference, a ``sent_id`` that occurs twice on one side and a null
    one raise an error when the result is computed. The ids alone are counted, by hashing;
    the texts are then joined to the counts, each moved once and never sorted by an aggregate.
    """
    ids = hyps.select("sent_id", F.lit(1).alias("h"), F.lit(0).alias("r")).unionByName(
        refs.select("sent_id", F.lit(0).alias("h"), F.lit(1).alias("r"))
    )
    counted = ids.groupBy("sent_id").agg(F.sum("h").alias("n_hyp"), F.sum("r").alias("n_ref"))
    fault = F.concat(F.lit("one reference and at most one hypothesis expected for sentence "), F.coalesce(F.col("sent_id").cast("string"), F.lit("null")))
    sound = (F.col("n_ref") == 1) & (F.col("n_hyp") <= 1) & F.col("sent_id").isNotNull()
    checked = counted.select("sent_id", F.when(sound, F.lit(True)).otherwise(F.raise_error(fault).cast("boolean")).alias("sound"))
    # Merged, not broadcast: the parts then follow the texts, and work on long texts is spread.
    both = checked.join(refs.select("sent_id", "ref").hint("merge"), "sent_id", "left")
    both = both.join(hyps.select("sent_id", "hyp").hint("merge"), "sent_id", "left")
    # The check is part of the reference, so that no plan can leave it out.
    return both.select(
        "sent_id", F.coalesce("hyp", F.lit("")).alias("hyp"), F.when(F.col("sound"), F.coalesce("ref", F.lit(""))).alias("ref")
    )


def missing_references(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Hypotheses without a reference."""
    return hyps.join(refs, "sent_id", "left_anti")


def _grams(tokens: Column, n: int, side: int) -> Column:
    """63-bit hashes of all n-grams, with the side in the lowest bit."""
    starts = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
    hashed = F.transform(starts, lambda i: F.xxhash64(F.slice(tokens, i, F.lit(n))).bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(side)))
    return F.when(F.size(tokens) >= n, hashed).otherwise(F.array().cast("array<bigint>"))


def _clipped(hyp: Column, ref: Column, n: int) -> Column:
    """How many n-grams two token lists share, each as often as it occurs in both.

    Both sides are sorted together, so equal n-grams stand in a row, those of the hypothesis
    first; each n-gram of the reference then takes one of those that are left.
    """
    state = lambda gram, left, total: F.struct(gram.alias("gram"), left.alias("left"), total.alias("total"))

    def step(s: Column, x: Column) -> Column:
        gram = x.bitwiseAND(F.lit(-2))
        same = s["gram"] == gram
        left = F.when(same, s["left"]).otherwise(0)
        taken = (left > 0).cast("int")
        return F.when(gram == x, state(gram, left + 1, s["total"])).otherwise(state(gram, left - taken, s["total"] + taken))

    start = state(F.lit(1).cast("bigint"), F.lit(0), F.lit(0))  # no n-gram is odd
    return F.aggregate(F.sort_array(F.concat(_grams(hyp, n, 0), _grams(ref, n, 1))), start, step, lambda s: s["total"])


def bleu_ngram_stats(aligned: DataFrame) -> DataFrame:
    """One row per order that has n-grams: ``(n, correct, total, ref_total)``.

    Matches are clipped inside the row, so no n-gram becomes a row and nothing is moved but
    the sums of each task. The n-grams of one sentence are told apart by 63-bit hashes.
    """
    cut = aligned.select(bleu_tokenize_13a(F.col("hyp")).alias("h"), bleu_tokenize_13a(F.col("ref")).alias("r"))
    orders = range(1, MAX_ORDER + 1)
    total = lambda side, n: F.greatest(F.size(side) - (n - 1), F.lit(0))
    sums = {}
    for n in orders:
        sums |= {f"c{n}": _clipped(F.col("h"), F.col("r"), n), f"t{n}": total("h", n), f"r{n}": total("r", n)}
    summed = cut.agg(*[F.coalesce(F.sum(column), F.lit(0)).alias(name) for name, column in sums.items()])
    each = [F.struct(F.lit(n).alias("n"), F.col(f"c{n}").alias("correct"), F.col(f"t{n}").alias("total"), F.col(f"r{n}").alias("ref_total")) for n in orders]
    return summed.select(F.inline(F.array(*each))).filter("total + ref_total > 0")


def corpus_bleu(aligned: DataFrame) -> DataFrame:
    """One row ``(bleu, brevity, sys_len, ref_len)``, exponential smoothing of zero counts."""
    stats = bleu_ngram_stats(aligned)

    def order(name: str, n: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("n") == n, F.col(name))), F.lit(0))

    wide = stats.agg(
        *[order("correct", n).alias(f"c{n}") for n in range(1, MAX_ORDER + 1)],
        *[order("total", n).alias(f"t{n}") for n in range(1, MAX_ORDER + 1)],
        order("ref_total", 1).alias("ref_len"),
    )
    zeros = F.lit(0)
    logs = F.lit(0.0)
    for n in range(1, MAX_ORDER + 1):
        correct, total = F.col(f"c{n}"), F.col(f"t{n}")
        zeros = zeros + F.when((total > 0) & (correct == 0), 1).otherwise(0)
        smoothed = F.lit(100.0) / (F.pow(F.lit(2.0), zeros) * total)
        precision = F.when(correct == 0, smoothed).otherwise(F.lit(100.0) * correct / total)
        logs = logs + F.ln(F.when(total > 0, precision))
    any_match = sum((F.col(f"c{n}") for n in range(1, MAX_ORDER + 1)), F.lit(0)) > 0
    full = F.least(*[F.col(f"t{n}") for n in range(1, MAX_ORDER + 1)]) > 0
    brevity = (
        F.when(F.col("t1") >= F.col("ref_len"), F.lit(1.0))
        .when(F.col("t1") > 0, F.exp(F.lit(1.0) - F.col("ref_len") / F.col("t1")))
        .otherwise(F.lit(0.0))
    )
    return wide.select(
        F.when(any_match & full, F.least(F.lit(100.0), brevity * F.exp(logs / MAX_ORDER))).otherwise(F.lit(0.0)).alias("bleu"),
        brevity.alias("brevity"),
        F.col("t1").alias("sys_len"),
        "ref_len",
    )


def first_batches(aligned: DataFrame, max_batches: int | None = None) -> DataFrame:
    """Keep the first batches (``batch_id`` from 0); ``None`` keeps all."""
    return aligned if max_batches is None else aligned.filter(F.col("batch_id") < max_batches)


def corpus_bleu_capped(aligned: DataFrame, max_batches: int | None = None) -> DataFrame:
    """BLEU over the first batches only when a number of them is asked for."""
    return corpus_bleu(first_batches(aligned, max_batches))
