"""Analytics over training-run logs.

``batch_log`` is ``(epoch, batch_idx, loss, n_tokens, elapsed_s)`` with ``batch_idx`` from
0; ``epoch_log`` is ``(epoch, train_loss, val_loss, bleu)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scores import noam_lr, perplexity
from ..plans.joins import join_on_groups
from ..plans.running import in_cells, with_running
from ..plans.sizing import small_side


def weighted_loss() -> Column:
    """Token-weighted mean loss of a group (an aggregate)."""
    return F.sum(F.col("loss") * F.col("n_tokens")) / F.greatest(F.sum("n_tokens"), F.lit(1))


def token_weighted_loss(batch_log: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Weighted loss and perplexity per key."""
    return (
        batch_log.groupBy(*keys)
        .agg(weighted_loss().alias("mean_loss"), F.sum("n_tokens").alias("n_tokens"))
        .withColumn("ppl", perplexity(F.col("mean_loss")))
    )


def accum_steps(batch_log: DataFrame, k: int, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mark the batches that trigger an update (every k-th and the last) and number the steps."""
    last = batch_log.groupBy(*keys).agg(F.max("batch_idx").alias("_last"))
    joined = join_on_groups(batch_log, small_side(last, "last-batches"), keys)
    return joined.select(
        *batch_log.columns,
        (((F.col("batch_idx") + 1) % k == 0) | (F.col("batch_idx") == F.col("_last"))).alias("is_update"),
        (F.floor(F.col("batch_idx") / k) + 1).alias("step"),
    )


def running_loss_log(
    batch_log: DataFrame, every: int = 50, keys: Sequence[str] = ("epoch",), parts: int | None = None
) -> DataFrame:
    """Running weighted loss, perplexity and tokens per second at each ``every``-th batch."""
    running = with_running(
        batch_log,
        keys,
        "batch_idx",
        {
            "loss_sum": ("sum", F.col("loss") * F.col("n_tokens")),
            "token_sum": ("sum", F.col("n_tokens").cast("long")),
        },
        parts=parts,
    )
    mean = F.col("loss_sum") / F.greatest("token_sum", F.lit(1))
    return running.filter((F.col("batch_idx") + 1) % every == 0).select(
        *keys,
        (F.col("batch_idx") + 1).alias("batch_no"),
        mean.alias("mean_loss"),
        perplexity(mean).alias("ppl"),
        (F.col("token_sum") / F.col("elapsed_s")).alias("tok_per_s"),
    )


def best_checkpoints(
    epoch_log: DataFrame, initial_best: float = 0.0, start_epoch: int | None = None,
    keys: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """Epochs whose BLEU strictly beats every earlier one.

    A resumed run passes the best so far and the epoch that it goes on from.
    """
    if start_epoch is not None:
        epoch_log = epoch_log.filter(F.col("epoch") >= start_epoch)
    running = with_running(
        epoch_log, keys, "epoch", {"_earlier": ("max", F.col("bleu"))}, inclusive=False, parts=parts
    )
    to_beat = F.greatest(F.coalesce("_earlier", F.lit(initial_best)), F.lit(initial_best))
    return running.filter(F.col("bleu") > to_beat).select(*keys, "epoch", F.col("bleu").alias("best_bleu"))


def periodic_snapshots(epoch_log: DataFrame, every: int = 5) -> DataFrame:
    """Epochs that are saved regularly, with the snapshot name."""
    return epoch_log.filter(F.col("epoch") % every == 0).select(
        "epoch", F.format_string("epoch_%03d", F.col("epoch")).alias("name")
    )


def generalization_gap(epoch_log: DataFrame) -> DataFrame:
    """Epochs with validation loss above training loss, and the gap."""
    return epoch_log.filter(F.col("val_loss") > F.col("train_loss")).select(
        "epoch", (F.col("val_loss") - F.col("train_loss")).alias("gap")
    )


def decode_throughput(
    item_log: DataFrame, every: int = 100, keys: Sequence[str] = ()
) -> DataFrame:
    """Items per second at each ``every``-th item and at the end.

    ``item_log`` is ``(item_no, elapsed_s)`` per key, ``item_no`` from 1; an optional
    boolean ``blank`` marks items that were passed through without a report.
    """
    if keys:
        total = item_log.groupBy(*keys).agg(F.max("item_no").alias("_total"))
        joined = join_on_groups(item_log, small_side(total, "item-totals"), keys)
    else:
        joined = item_log.withColumn("_total", F.lit(item_log.agg(F.max("item_no")).first()[0]))
    due = (F.col("item_no") % every == 0) | (F.col("item_no") == F.col("_total"))
    if "blank" in item_log.columns:
        due = due & ~F.col("blank")
    return joined.filter(due).select(
        *keys, "item_no", (F.col("item_no") / F.col("elapsed_s")).alias("items_per_s")
    )


def lr_curve(steps: DataFrame, d_model: int = 512, warmup: int = 4000, factor: float = 1.0) -> DataFrame:
    """Learning rate of each ``step``."""
    return steps.withColumn("lr", noam_lr(F.col("step"), d_model, warmup, factor))


def lr_peak(curve: DataFrame) -> DataFrame:
    """The step with the highest rate (the first, on a tie) and that rate."""
    top = F.max(F.struct(F.col("lr"), (-F.col("step")).alias("neg_step")))
    return curve.agg(top.alias("t")).select((-F.col("t.neg_step")).alias("peak_step"), F.col("t.lr").alias("peak_lr"))


def interpolate(
    known: DataFrame, grid: DataFrame, series: Sequence[str] = (), parts: int | None = None
) -> DataFrame:
    """Fill ``known(series, x, y)`` on ``grid(series, x)``: linear between known points, flat outside.

    Each grid point looks for the last known point at or before it and the first at or
    after it. Points are range-partitioned by series and axis, so that one long series
    spreads over many tasks; the end points of each part carry across the cuts.
    """
    point = F.struct("x", "y")
    rows = known.select(*series, F.col("x").cast("double"), F.col("y").cast("double"), F.lit(False).alias("_grid")).unionByName(
        grid.select(*series, F.col("x").cast("double"), F.lit(None).cast("double").alias("y"), F.lit(True).alias("_grid"))
    )
    rows = in_cells(rows, series, "x", parts).withColumn("_known", F.when(~F.col("_grid"), point))
    ends = rows.groupBy("_cell").agg(F.min("_known").alias("_lo"), F.max("_known").alias("_hi"))
    across = Window.partitionBy(*[F.col("_cell")[s] for s in series])
    place = F.col("_cell")["_part"]
    carried = ends.select(
        "_cell",
        F.last("_hi", ignorenulls=True)
        .over(across.orderBy(place).rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.last("_lo", ignorenulls=True)
        .over(across.orderBy(place.desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"),
    )
    inside = Window.partitionBy("_cell")
    seen = rows.select(
        *series, "_cell", "x", "_grid",
        F.last("_known", ignorenulls=True).over(inside.orderBy("x")).alias("_left"),
        F.last("_known", ignorenulls=True).over(inside.orderBy(F.desc("x"))).alias("_right"),
    ).filter("_grid")
    left = F.coalesce("_left", "_before")
    right = F.coalesce("_right", "_after")
    placed = seen.join(carried, "_cell").select(*series, "x", left.alias("a"), right.alias("b"))
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    return placed.select(
        *series,
        "x",
        F.when(F.col("a").isNull(), F.col("b.y"))
        .when(F.col("b").isNull() | (F.col("a.x") == F.col("b.x")), F.col("a.y"))
        .otherwise(F.col("a.y") + slope * (F.col("x") - F.col("a.x")))
        .alias("y"),
    )
