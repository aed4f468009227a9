from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from twinline.operators import batching as B, codec, pairs as P, vocab as V

SIZES = {"train": 53, "validation": 10, "test": 8}


@pytest.fixture(scope="module")
def pairs(spark):
    rows, i = [], 0
    for split, n in SIZES.items():
        for _ in range(n):
            rows.append((i * 7 % 1000, split, [2] + [4] * (i % 9) + [3], [2] + [5] * (i % 11) + [3]))
            i += 1
    return spark.createDataFrame(rows, "pair_id int, split string, src_ids array<int>, tgt_ids array<int>")


def test_assignment(pairs):
    rows = B.assign_batches(pairs, 8, seed="s").collect()
    by_split = {s: sorted((r.batch_id, r.pos, r.pair_id) for r in rows if r.split == s) for s in SIZES}
    assert [len(by_split[s]) for s in SIZES] == [48, 10, 8]
    source = [r.pair_id for r in pairs.filter("split = 'train'").collect()]
    mixed = sorted(source, key=lambda p: (hashlib.md5(f"s:{p}".encode()).hexdigest(), p))
    assert [p for _, _, p in by_split["train"]] == mixed[:48]
    assert [p for _, _, p in by_split["validation"]] == sorted(r.pair_id for r in pairs.filter("split = 'validation'").collect())
    for s in SIZES:
        assert [(b, pos) for b, pos, _ in by_split[s]] == [(i // 8, i % 8) for i in range(len(by_split[s]))]


def test_origins_may_share_ids(pairs):
    both = pairs.withColumn("origin", F.lit("base")).unionByName(pairs.withColumn("origin", F.lit("extra")))
    place = lambda: {(r.origin, r.split, r.pair_id): (r.batch_id, r.pos) for r in B.assign_batches(both, 8, seed=3).collect()}
    first = place()
    assert first == place() and len(set((k[1], *v) for k, v in first.items())) == len(first)


def test_padding_masks_and_counts(pairs):
    rows = B.build_batches(pairs, 8, seed=1).collect()
    batches = {}
    for r in rows:
        batches.setdefault((r.split, r.batch_id), []).append(r)
    for group in batches.values():
        assert len({len(r.src_ids) for r in group}) == 1 and len({len(r.tgt_ids) for r in group}) == 1
        for r in group:
            assert r.tgt_in == r.tgt_ids[:-1] and r.tgt_out == r.tgt_ids[1:]
            assert r.src_mask == [x == 0 for x in r.src_ids]
            n = len(r.tgt_in)
            assert r.tgt_mask == [[j > i or r.tgt_in[j] == 0 for j in range(n)] for i in range(n)]
    counts = {(r.split, r.batch_id): r.n_tokens for r in B.batch_token_count(B.build_batches(pairs, 8, seed=1)).collect()}
    for key, group in batches.items():
        assert counts[key] == sum(sum(1 for x in r.tgt_ids if x) - 1 for r in group)


def test_literal_padding(spark):
    df = spark.createDataFrame([("t", 0, [2, 5, 3]), ("t", 0, [2, 3])], "split string, batch_id int, tgt_ids array<int>")
    padded = B.with_decoder_sides(B.pad_batch(df, ["tgt_ids"]))
    got = {tuple(r.tgt_ids): (r.tgt_in, r.tgt_out) for r in padded.collect()}
    assert got == {(2, 5, 3): ([2, 5], [5, 3]), (2, 3, 0): ([2, 3], [3, 0])}
    assert B.batch_token_count(padded).first().n_tokens == 3


def test_counts_agree_with_assignment(pairs):
    told = {r.split: r.n_batches for r in P.batch_counts(pairs, 8).collect()}
    made = {r.split: r.n for r in B.assign_batches(pairs, 8).groupBy("split").agg(F.countDistinct("batch_id").alias("n")).collect()}
    assert told == made == {"train": 6, "validation": 2, "test": 1}


def test_encode_batch(spark):
    df = spark.createDataFrame([(0, "aa b"), (0, ""), (1, "b")], "g int, t string")
    v = V.character_vocabulary(V.word_counts(df, "t"))
    grouped = {(r.g, r.t): (r.ids, r.attention_mask) for r in codec.encode_batch(df, v, "t", ["g"]).collect()}
    assert grouped == {
        (0, "aa b"): ([2, 4, 4, 5, 3], [1] * 5), (0, ""): ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0]), (1, "b"): ([2, 5, 3], [1] * 3)
    }
    whole = {(r.g, r.t): r.ids for r in codec.encode_batch(df, v, "t", max_len=4).collect()}
    assert whole[(1, "b")] == [2, 5, 3, 0] and whole[(0, "aa b")] == [2, 4, 4, 3]


def test_whole_rows_move_once(spark):
    pairs = spark.createDataFrame(
        [(i, "train" if i % 3 else "test", list(range(2, 3 + i % 7)), [2, 3], "x" * 50) for i in range(40)],
        "pair_id int, split string, src_ids array<int>, tgt_ids array<int>, note string",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = B.assign_batches(pairs, 4, lengths_of=("src_ids", "tgt_ids"))
        padded = B.pad_batch(placed)
        assert padded.columns == [*pairs.columns, "batch_id", "pos"]
        plan = padded._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and plan.count("note#") > 0
        wide = [r for r in padded._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in r and "note" in r]
        assert len(wide) <= 1
        sizes = {}
        for r in padded.collect():
            sizes.setdefault((r.split, r.batch_id), set()).add((len(r.src_ids), len(r.tgt_ids)))
        assert all(len(s) == 1 for s in sizes.values())
        assert {r.split: r.n_dropped for r in B.dropped_rows(pairs, 4).collect()} == {"train": 26 % 4, "test": 0}
        with pytest.raises(Exception, match="pair_id is not unique: 7"):
            B.assign_batches(pairs.union(pairs.filter("pair_id = 7")), 4).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
