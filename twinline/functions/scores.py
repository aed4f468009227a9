"""Scores over stored model outputs, and the learning-rate formula."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .text import PAD


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    A lambda evaluates everything inside it per element, so what does not depend on
    the element is bound outside as the only element of an array.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def log_sum_exp(xs: Column) -> Column:
    """Logarithm of the sum of exponentials, shifted by the maximum."""

    def shifted(top: Column) -> Column:
        return F.aggregate(
            xs, F.lit(0.0), lambda total, x: total + F.exp(x - top), lambda total: top + F.ln(total)
        )

    return _bind(F.array_max(xs), shifted)


def softmax(xs: Column) -> Column:
    """Probabilities, shifted by the maximum."""
    return _bind(log_sum_exp(xs), lambda norm: F.transform(xs, lambda x: F.exp(x - norm)))


def log_softmax(xs: Column) -> Column:
    """Log-probabilities, shifted by the maximum."""
    return _bind(log_sum_exp(xs), lambda norm: F.transform(xs, lambda x: x - norm))


def argmax_id(xs: Column) -> Column:
    """0-based index of the largest entry; the lowest index wins a tie."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def position_loss(logits: Column, target: Column, smoothing: float = 0.1) -> Column:
    """Label-smoothed cross-entropy of one position; 0 where the target is PAD.

    The target keeps ``1 - smoothing``, PAD gets nothing and each of the other
    V - 2 entries gets ``smoothing / (V - 2)``, so the sum needs only the
    normaliser, the sum of the logits, and the logits at the target and at PAD.
    """
    size = F.size(logits)

    def loss(norm: Column) -> Column:
        total = F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + x) - size * norm
        at_target = F.element_at(logits, target + 1) - norm
        at_pad = F.element_at(logits, PAD + 1) - norm
        spread = smoothing / (size - 2) * (total - at_target - at_pad)
        return -((1 - smoothing) * at_target + spread)

    return F.when(target == PAD, F.lit(0.0)).otherwise(_bind(log_sum_exp(logits), loss))


def perplexity(loss: Column) -> Column:
    """``exp`` of the loss, the loss taken as at most 20."""
    return F.exp(F.least(loss, F.lit(20.0)))


def noam_lr(step: Column, d_model: int = 512, warmup: int = 4000, factor: float = 1.0) -> Column:
    """Linear warm-up, then inverse square root; 0 at step 0."""
    step = step.cast("double")
    rate = F.lit(factor * d_model ** -0.5) * F.least(
        F.pow(step, F.lit(-0.5)), step * F.lit(warmup ** -1.5)
    )
    return F.when(step == 0, F.lit(0.0)).otherwise(rate)


def length_penalised_score(score: Column, length: Column, alpha: float = 0.6) -> Column:
    """Score over ``((5 + length) / 6) ** alpha``; length counts SOS and EOS."""
    return score / F.pow((F.lit(5.0) + length) / F.lit(6.0), F.lit(float(alpha)))
