from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinline.functions import scores as S


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_noam(spark):
    at = lambda step: _value(spark, S.noam_lr(F.lit(step)))
    assert at(4000) == pytest.approx((512 * 4000) ** -0.5)
    assert at(0) == 0.0
    assert at(1) == pytest.approx(512 ** -0.5 * 4000 ** -1.5)
    assert at(8595) == pytest.approx((512 * 8595) ** -0.5)


def test_length_penalty(spark):
    assert _value(spark, S.length_penalised_score(F.lit(-4.0), F.lit(7), 0.6)) == pytest.approx(-4 / 2 ** 0.6)
    assert _value(spark, S.length_penalised_score(F.lit(-4.0), F.lit(7), 0.0)) == -4.0


def test_perplexity_is_bounded(spark):
    assert _value(spark, S.perplexity(F.lit(25.0))) == pytest.approx(math.exp(20))
    assert _value(spark, S.perplexity(F.lit(2.0))) == pytest.approx(math.exp(2))


def test_softmax_and_loss_match_numpy(spark):
    rng = np.random.default_rng(3)
    logits = rng.normal(0, 40, size=(12, 9))
    targets = rng.integers(0, 9, size=12)
    targets[0] = 0
    rows = [(i, [float(x) for x in logits[i]], int(targets[i])) for i in range(12)]
    df = spark.createDataFrame(rows, "i int, logits array<double>, target int")
    got = df.select(
        "i", S.log_softmax(F.col("logits")).alias("lp"), S.softmax(F.col("logits")).alias("p"),
        S.position_loss(F.col("logits"), F.col("target"), 0.1).alias("loss"),
        S.argmax_id(F.col("logits")).alias("best"),
    ).orderBy("i").collect()
    shifted = logits - logits.max(1, keepdims=True)
    lp = shifted - np.log(np.exp(shifted).sum(1, keepdims=True))
    for i, row in enumerate(got):
        np.testing.assert_allclose(row.lp, lp[i], atol=1e-9)
        np.testing.assert_allclose(row.p, np.exp(lp[i]), atol=1e-12)
        smooth = np.full(9, 0.1 / 7)
        smooth[targets[i]] = 0.9
        smooth[0] = 0.0
        expected = 0.0 if targets[i] == 0 else -(smooth * lp[i]).sum()
        assert row.loss == pytest.approx(expected, abs=1e-9)
        assert row.best == int(logits[i].argmax())


def test_argmax_tie_goes_to_the_lowest(spark):
    assert _value(spark, S.argmax_id(F.array(F.lit(1.0), F.lit(5.0), F.lit(5.0)))) == 1
