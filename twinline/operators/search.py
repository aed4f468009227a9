"""Greedy and beam search over a table of next-token log-probabilities, and n-best ranking.

``transitions`` is ``(prev_id, next_id, logp)``, one table for all sentences. With a column
``sent_id``, ``step`` (0 for the first new token) or both, scores depend on the sentence and
on the place in it, as a model's do. ``starts`` is ``(sent_id, ids)``. All sentences advance
together, one token per step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ids import cut_at_eos
from ..functions.scores import length_penalised_score
from ..functions.text import EOS
from ..plans.sizing import broadcast_if_small
from ..plans.stages import drop_bucketed, drop_stage, write_bucketed, write_stage

STEPS_PER_STAGE = 8


def topk_tokens(candidates: DataFrame, keys: list[str], k: int, token: str = "next_id") -> DataFrame:
    """The ``k`` best tokens per key with their ``token_rank`` (ties to the lower id).

    The rank filter becomes a group limit below the shuffle, so each task sends at
    most ``k`` rows per key however many rows a key has.
    """
    best = Window.partitionBy(*keys).orderBy(F.desc("logp"), token)
    return candidates.withColumn("token_rank", F.row_number().over(best)).filter(
        F.col("token_rank") <= k
    )


def ban_eos(candidates: DataFrame, step: Column | int, min_len: int = 1, token: str = "next_id") -> DataFrame:
    """Remove EOS from the candidates of steps before ``min_len``."""
    step = F.lit(step) if isinstance(step, int) else step
    return candidates.filter((step >= min_len) | (F.col(token) != EOS))


def expand_beam(beam: DataFrame, transitions: DataFrame, step: int | None = None, keep_ended: bool = False) -> DataFrame:
    """Each live hypothesis with each of its candidates: ``score`` and ``ids`` extended, other columns kept.

    Cut ``transitions`` with :func:`topk_tokens` first when only the best are wanted: the
    output has one row per hypothesis and candidate. ``step`` picks the scores of that step.
    With ``keep_ended``, hypotheses that are done or have no candidate stay as they are;
    ``moved`` tells the others, and those without a candidate are done.

    Scores by sentence are joined on the sentence alone, the token being tested inside the
    join, so a beam and a table that are both laid out by sentence meet without a shuffle.
    """
    if "step" in transitions.columns:
        transitions = transitions.filter(F.col("step") == step).drop("step")
    last = F.when(~F.col("done"), F.element_at("ids", -1))
    same = last == F.col("prev_id")
    if "sent_id" in transitions.columns:
        transitions = transitions.withColumnRenamed("sent_id", "_sent")
        same = (F.col("sent_id") == F.col("_sent")) & (last - F.col("prev_id") == 0)
    grown = beam.join(transitions, same, "left" if keep_ended else "inner").drop("prev_id", "_sent")
    moved = F.col("next_id").isNotNull()
    grown = grown.withColumns(
        {
            "score": F.when(moved, F.col("score") + F.col("logp")).otherwise(F.col("score")),
            "ids": F.when(moved, F.concat("ids", F.array("next_id"))).otherwise(F.col("ids")),
            "done": F.when(moved, F.col("next_id") == EOS).otherwise(F.lit(True)),
        }
    )
    return grown.withColumn("moved", moved) if keep_ended else grown


def prune_beam(candidates: DataFrame, k: int, tie_break: list[str], keep_ended: bool = False) -> DataFrame:
    """The ``k`` best unfinished hypotheses per sentence by raw score, with ``hyp_rank``; all others too with ``keep_ended``."""
    if not keep_ended:
        candidates = candidates.filter(~F.col("done"))
    best = Window.partitionBy("sent_id").orderBy("done", F.desc("score"), *tie_break)
    return candidates.withColumn("hyp_rank", F.row_number().over(best)).filter(F.col("done") | (F.col("hyp_rank") <= k))


def nbest_rank(
    hyps: DataFrame, tie_break: list[str], beam_width: int, alpha: float = 0.6, n_best: int | None = None
) -> DataFrame:
    """Order a sentence's hypotheses by penalised score; keep ``beam_width``, then ``n_best``."""
    best = Window.partitionBy("sent_id").orderBy(F.desc("lp_score"), *tie_break)
    keep = beam_width if n_best is None else min(beam_width, n_best)
    return (
        hyps.withColumn("lp_score", length_penalised_score(F.col("score"), F.size("ids"), alpha))
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= keep)
    )


def show_alternatives(hyps: DataFrame, tie_break: list[str], beam_width: int, alpha: float = 0.6) -> DataFrame:
    """All kept hypotheses with rank and penalised score."""
    return nbest_rank(hyps, tie_break, beam_width, alpha)


def _advance(state: DataFrame, step_fn: Callable[[DataFrame, int], DataFrame], steps: int) -> DataFrame:
    """Apply ``step_fn`` up to ``steps`` times, stopping once no row is live.

    A run of a few steps is one plan (joins with a broadcast table keep the partitioning
    by sentence, so it shuffles once); between runs the state is written to the shared
    folder, which bounds the plan and lets the loop see whether any row is live.
    """
    spark = state.sparkSession
    path = None
    for step in range(steps):
        state = step_fn(state, step)
        if (step + 1) % STEPS_PER_STAGE == 0 and step + 1 < steps:
            old = path
            state, path = write_stage(state, "search")
            if old is not None:
                drop_stage(spark, old)
            if not state.filter("NOT done").take(1):
                break
    return state


def _candidates(transitions: DataFrame, k: int) -> tuple[list[str], DataFrame, str | None]:
    """The ``k`` best tokens of every state, written once, as every step reads them; with the table's name if it has one.

    Scores by sentence are bucketed by sentence, in as many buckets as a shuffle has parts,
    so that joining them with the beam (laid out by sentence as well) moves nothing.
    """
    keys = [c for c in ("sent_id", "step") if c in transitions.columns] + ["prev_id"]
    best = topk_tokens(transitions, keys, k)
    if "sent_id" not in keys:
        return keys, write_stage(best, "candidates")[0], None
    table, name = write_bucketed(best, "candidates", "sent_id")
    return keys, table, name


def beam_hypotheses(
    starts: DataFrame, transitions: DataFrame, beam_width: int = 5, max_len: int = 128, min_len: int = 1
) -> DataFrame:
    """All hypotheses of the search, unranked: ``sent_id, hyp_id, score, ids, finished, ended``.

    A finished hypothesis takes no slot of the beam. A sentence stops once ``beam_width``
    hypotheses are finished; those still live are then kept as they are and may win. A
    hypothesis without a candidate stops and stays as it is, unfinished: every sentence of
    ``starts`` has a result. ``ended`` (the step) and ``hyp_id`` order equal scores.
    """
    # One spare candidate per state is enough to fill the beam when EOS is banned.
    keys, spare, name = _candidates(transitions, beam_width + 1)
    share = (lambda df: df) if name else broadcast_if_small
    anywhere = share(spare.filter(F.col("token_rank") <= beam_width))
    early = share(topk_tokens(ban_eos(spare, 0), keys, beam_width))
    sentence = Window.partitionBy("sent_id")

    def step_fn(state: DataFrame, step: int) -> DataFrame:
        grown = expand_beam(state, early if step < min_len else anywhere, step, keep_ended=True)
        place = F.when(F.col("moved"), F.col("hyp_id") * beam_width + F.col("token_rank")).otherwise(F.col("hyp_id"))
        grown = grown.withColumns(
            {
                "hyp_id": place.cast("long"),
                "finished": F.col("finished") | (F.col("moved") & F.col("done")),
                "ended": F.when(F.col("live"), F.lit(step)).otherwise(F.col("ended")),
            }
        )
        pruned = prune_beam(grown, beam_width, ["hyp_id"], keep_ended=True)
        full = F.count(F.when(F.col("finished"), 1)).over(sentence) >= beam_width
        stop = ~F.col("done") & full
        return pruned.select(
            "sent_id",
            F.when(F.col("done"), F.col("hyp_id")).otherwise(F.col("hyp_rank").cast("long")).alias("hyp_id"),
            "score",
            "ids",
            (F.col("done") | stop).alias("done"),
            (~F.col("done") & ~stop).alias("live"),
            "finished",
            F.when(stop, F.lit(max_len)).otherwise(F.col("ended")).alias("ended"),
        )

    start = starts.select(
        "sent_id",
        F.lit(0).cast("long").alias("hyp_id"),
        F.lit(0.0).alias("score"),
        F.col("ids").cast("array<int>").alias("ids"),
        F.lit(False).alias("done"),
        F.lit(True).alias("live"),
        F.lit(False).alias("finished"),
        F.lit(0).alias("ended"),
    )
    if name:
        start = start.repartition(_shuffle_parts(starts.sparkSession), "sent_id")
    ended = F.when(F.col("live"), F.lit(max_len)).otherwise(F.col("ended")).alias("ended")
    found = _advance(start, step_fn, max_len).select("sent_id", "hyp_id", "score", "ids", "finished", ended)
    return _settled(found, name)


def _settled(found: DataFrame, name: str | None) -> DataFrame:
    """The result written, where a bucketed table that it reads is to be dropped."""
    if name is None:
        return found
    written, _ = write_stage(found, "search")
    drop_bucketed(found.sparkSession, name)
    return written


def _cut(hyps: DataFrame) -> DataFrame:
    return hyps.withColumn("ids", cut_at_eos(F.slice("ids", F.lit(2), F.size("ids"))))


def beam_search(
    starts: DataFrame,
    transitions: DataFrame,
    beam_width: int = 5,
    max_len: int = 128,
    alpha: float = 0.6,
    min_len: int = 1,
    n_best: int | None = None,
) -> DataFrame:
    """Ranked hypotheses as ``(sent_id, rank, ids, score, lp_score)``, SOS and EOS removed; see :func:`beam_hypotheses`."""
    found = beam_hypotheses(starts, transitions, beam_width, max_len, min_len)
    ranked = nbest_rank(found, ["ended", "hyp_id"], beam_width, alpha, n_best)
    return _cut(ranked).select("sent_id", "rank", "ids", "score", "lp_score")


def greedy_decode(starts: DataFrame, transitions: DataFrame, max_len: int = 128) -> DataFrame:
    """Best next token each step, at most ``max_len - 1`` of them, as ``(sent_id, ids, score)``.

    The start ids' first entry (SOS) and everything from EOS on are removed.
    """
    _, best, name = _candidates(transitions, 1)
    best = best.drop("token_rank") if name else broadcast_if_small(best.drop("token_rank"))
    start = starts.select(
        "sent_id", F.col("ids").cast("array<int>").alias("ids"), F.lit(0.0).alias("score"), F.lit(False).alias("done")
    )
    if name:
        start = start.repartition(_shuffle_parts(starts.sparkSession), "sent_id")
    step_fn = lambda state, step: expand_beam(state, best, step, keep_ended=True).select("sent_id", "ids", "score", "done")
    found = _settled(_advance(start, step_fn, max_len - 1), name)
    return _cut(found).select("sent_id", "ids", "score")


def _shuffle_parts(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
