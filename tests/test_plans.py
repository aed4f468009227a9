from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinline.operators import pairs as P
from twinline.plans import row_index, sizing, stages
from twinline.plans.running import with_running

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("partitions", ["1", "5"])
def test_row_index_with_a_hot_group(spark, partitions):
    rng = random.Random(1)
    # Two thirds of the rows share one group and one leading key.
    rows = [("hot" if rng.random() < 0.67 else rng.choice("abc"), 7 if rng.random() < 0.67 else rng.randint(0, 9), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a int, b int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = row_index.with_row_index(df, ["a", "b"], within=["g"], out="i", total="n").collect()
        everything = row_index.with_row_index(df, ["g", "a", "b"], out="i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for group in {r[0] for r in rows}:
        expected = sorted(r for r in rows if r[0] == group)
        mine = sorted((r.i, (r.g, r.a, r.b), r.n) for r in got if r.g == group)
        assert mine == [(i, row, len(expected)) for i, row in enumerate(expected)]
    assert sorted((r.i, (r.g, r.a, r.b)) for r in everything) == list(enumerate(sorted(rows)))


@pytest.mark.parametrize("parts", [None, 3, 12])
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_does_not_depend_on_the_parts(spark, parts, inclusive):
    rng = random.Random(2)
    rows = [(g, i, rng.randint(-5, 9)) for g in "xy" for i in range(20) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    out = with_running(
        df, ["g"], "i", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, inclusive=inclusive, parts=parts
    )
    for r in out.collect():
        seen = [v for g, i, v in rows if g == r.g and (i <= r.i if inclusive else i < r.i)]
        assert r.s == sum(seen) and r.m == (max(seen) if seen else None)


def test_null_groups_are_kept(spark):
    rows = [(g, i, 1) for g in ("x", None) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, i int, v int")
    numbered = row_index.with_row_index(df, ["i"], within=["g"], out="at").collect()
    assert sorted((r.g or "", r.at) for r in numbered) == [(g, i) for g in ("", "x") for i in range(5)]
    summed = with_running(df, ["g"], "i", {"s": ("sum", F.col("v"))}, parts=4).collect()
    assert sorted((r.g or "", r.s) for r in summed) == [(g, i + 1) for g in ("", "x") for i in range(5)]


def test_broadcast_is_bounded(spark):
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(sizing.broadcast_if_small(spark.range(10), 160))
    assert not hinted(sizing.broadcast_if_small(spark.range(11), 160))


def test_spread_leaves_wide_scans_alone(spark):
    cores = spark.sparkContext.defaultParallelism
    assert sizing.spread(spark.range(100, numPartitions=1)).rdd.getNumPartitions() == cores
    wide = spark.range(100, numPartitions=cores + 3)
    assert sizing.spread(wide) is wide


def test_caps_filter_by_the_last_key(spark):
    rows = [(i * 37 % 101, "train", "s", "t") for i in range(101)]
    df = spark.createDataFrame(rows, "pair_id int, split string, src string, tgt string")
    capped = P.cap_pairs(df, 40)
    assert sorted(r.pair_id for r in capped.collect()) == list(range(40))
    plan = capped._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    assert P.cap_pairs(df, 500).count() == 101
    assert P.cap_pairs(df, None) is df and P.cap_pairs(df, 0) is df


def test_caps_are_exact_where_ids_repeat_or_are_null(spark):
    rows = [(i, "train", f"s{i}", "t") for i in range(30)] + [(30, "train", f"u{i}", "t") for i in range(40)]
    rows += [(31, "train", "same", "t")] * 50 + [(None, "train", f"n{i}", "t") for i in range(5)] + [(1 << 62, "train", "far", "t"), (-(1 << 62), "train", "low", "t")]
    df = spark.createDataFrame(rows, "pair_id long, split string, src string, tgt string")
    order = lambda i: (i is not None, i or 0)
    for n in (3, 5, 6, 36, 50, 76, 90, 126, 127, 500):
        got = P.cap_pairs(df, n).collect()
        expected = sorted((r[0] for r in rows), key=order)[:n]
        assert sorted((r.pair_id for r in got), key=order) == expected, n
        # Rows are kept whole and, beyond equal ones, once.
        assert set(map(tuple, got)) <= set(rows) and len({tuple(r) for r in got if r.pair_id == 30}) == expected.count(30)
    assert sorted(map(tuple, P.cap_pairs(df, 50).collect()), key=str) == sorted(map(tuple, P.cap_pairs(df.repartition(5), 50).collect()), key=str)
    assert P.cap_pairs(df.limit(0), 4).count() == 0


def test_stages_lie_in_the_shared_folder(spark):
    df, path = stages.write_stage(spark.range(3), "t")
    assert path.startswith(stages.shared_root(spark)) and df.count() == 3
    stages.drop_stage(spark, path)
    assert not stages.path_exists(spark, path)


def test_source_keeps_to_the_rules():
    for path in list((ROOT / "twinline").rglob("*.py")) + list((ROOT / "checks").rglob("*.py")):
        code = path.read_text(encoding="utf-8")
        for banned in ("localCheckpoint", "crossJoin", "toPandas(", ".toLocalIterator", "F.udf("):
            assert banned not in code, (path, banned)
