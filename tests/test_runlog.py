from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinline.operators import lengths, runlog as R
from twinline.plans.running import in_cells


def _log(spark, n=765, epochs=(1,)):
    return spark.createDataFrame(
        [(e, i, 2.0 + (i % 5) / 10, i % 7, (i + 1) * 0.5) for e in epochs for i in range(n)],
        "epoch int, batch_idx int, loss double, n_tokens int, elapsed_s double",
    )


def test_updates_per_epoch(spark):
    steps = R.accum_steps(_log(spark), 4)
    assert steps.filter("is_update").count() == 192
    last = steps.filter("batch_idx = 764").first()
    assert last.is_update and last.step == 192
    assert R.accum_steps(_log(spark, 8), 1).filter("is_update").count() == 8


def test_weighted_loss_without_tokens(spark):
    df = spark.createDataFrame([(1, 5.0, 0), (2, 30.0, 2), (2, 10.0, 6)], "epoch int, loss double, n_tokens int")
    got = {r.epoch: (r.mean_loss, r.ppl) for r in R.token_weighted_loss(df).collect()}
    assert got[1] == (0.0, 1.0)
    assert got[2][0] == pytest.approx(15.0) and got[2][1] == pytest.approx(np.exp(15.0))


@pytest.mark.parametrize("parts", [None, 5])
def test_running_log(spark, parts):
    rows = R.running_loss_log(_log(spark, 120, (1, 2)), 50, parts=parts).orderBy("epoch", "batch_no").collect()
    assert [(r.epoch, r.batch_no) for r in rows] == [(1, 50), (1, 100), (2, 50), (2, 100)]
    w = np.array([i % 7 for i in range(100)])
    loss = np.array([2.0 + (i % 5) / 10 for i in range(100)])
    assert rows[1].mean_loss == pytest.approx((w * loss).sum() / w.sum())
    assert rows[1].tok_per_s == pytest.approx(w.sum() / 50.0)


@pytest.mark.parametrize("parts", [None, 3])
def test_best_checkpoints(spark, parts):
    scores = [0.0, 3.0, 3.0, 2.0, 5.0, 4.0, 5.1]
    df = spark.createDataFrame([(i + 1, 0.0, 0.0, b) for i, b in enumerate(scores)], "epoch int, train_loss double, val_loss double, bleu double")
    best = lambda **kw: sorted(r.epoch for r in R.best_checkpoints(df, parts=parts, **kw).collect())
    assert best() == [2, 5, 7]
    assert best(initial_best=3.0, start_epoch=3) == [5, 7]
    assert best(initial_best=9.0) == []
    named = {r.epoch: r.name for r in R.periodic_snapshots(df, 3).collect()}
    assert named == {3: "epoch_003", 6: "epoch_006"}


def test_gap(spark):
    df = spark.createDataFrame([(1, 3.0, 2.5, 0.0), (2, 2.0, 2.5, 0.0), (3, 2.0, 2.0, 0.0)], "epoch int, train_loss double, val_loss double, bleu double")
    assert [(r.epoch, r.gap) for r in R.generalization_gap(df).collect()] == [(2, 0.5)]


def test_throughput_skips_blank_items(spark):
    df = spark.createDataFrame([(i, i * 0.5, i == 100) for i in range(1, 251)], "item_no int, elapsed_s double, blank boolean")
    assert sorted((r.item_no, r.items_per_s) for r in R.decode_throughput(df).collect()) == [(200, 2.0), (250, 2.0)]
    assert sorted(r.item_no for r in R.decode_throughput(df.drop("blank")).collect()) == [100, 200, 250]


@pytest.mark.parametrize("parts", [None, 6])
@pytest.mark.parametrize("unit", [1.0, 1 / 64, float(2**20)])
def test_interpolation_is_numpy_interp(spark, parts, unit):
    curves = {"loss": ([2, 3, 7, 11, 20, 21, 33, 48], [6.5, 6.1, 4.4, 3.9, 3.95, 2.2, 2.0, 2.4]), "bleu": ([3, 40], [1.5, 29.0]), "one": ([9], [1.5])}
    known = spark.createDataFrame([(n, x * unit, y) for n, (xs, ys) in curves.items() for x, y in zip(xs, ys)], "name string, x double, y double")
    grid = spark.createDataFrame([(n, x * unit) for n in curves for x in range(0, 51)], "name string, x double")
    got = {(r.name, r.x): r.y for r in R.interpolate(known, grid, ["name"], parts=parts).collect()}
    assert len(got) == 3 * 51
    for name, (xs, ys) in curves.items():
        np.testing.assert_allclose([got[(name, x * unit)] for x in range(51)], np.interp(range(51), xs, ys))
    if parts:  # a long series is cut, whatever the unit of its axis
        assert in_cells(grid, ["name"], "x", parts).filter("name = 'bleu'").select("_cell").distinct().count() > 1
    alone = R.interpolate(known.filter("name = 'bleu'").drop("name"), grid.filter("name = 'bleu'").drop("name"), parts=parts)
    assert alone.count() == 51


def test_lr_curve_and_peak(spark):
    steps = spark.range(1, 8596).withColumnRenamed("id", "step")
    peak = R.lr_peak(R.lr_curve(steps)).first()
    assert peak.peak_step == 4000 and peak.peak_lr == pytest.approx((512 * 4000) ** -0.5)


def _lengths(spark, values):
    return spark.createDataFrame([(v,) for v in values], "n_tokens int")


def test_length_stats(spark):
    row = lengths.token_length_stats(_lengths(spark, [1, 2, 10, 40])).first()
    assert (row.mean_len, row.median_len, row.max_len) == (13.25, 6.0, 40) and row.p95_len == pytest.approx(35.5)
    assert lengths.over_max_len_share(_lengths(spark, [128, 129, 1, 1])).first().over_share == 0.25


@pytest.mark.parametrize("values", [[3, 3, 3], list(range(100)) + [7] * 9 + [99], [0, 1], [5, 900, 901, 20]])
@pytest.mark.parametrize("bins", [1, 7, 40])
def test_histogram_is_numpy_histogram(spark, values, bins):
    rows = lengths.token_length_histogram(_lengths(spark, values), bins=bins).orderBy("bin").collect()
    n, edges = np.histogram(values, bins=bins)
    assert [r.bin for r in rows] == list(range(bins))
    np.testing.assert_allclose([r.lo for r in rows] + [rows[-1].hi], edges)
    assert [r.n for r in rows] == list(n)
    assert sum(r.n for r in rows) == len(values)
