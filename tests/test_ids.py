from __future__ import annotations

from pyspark.sql import functions as F

from twinline.functions import ids as I


def _one(spark, ids, fn):
    return spark.createDataFrame([(ids,)], "ids array<int>").select(fn(F.col("ids")).alias("r")).first().r


def test_truncate(spark):
    assert _one(spark, [2, 12, 13, 14, 12, 3], lambda c: I.truncate_ids(c, 4)) == [2, 12, 13, 3]
    assert _one(spark, [2, 12, 13, 3], lambda c: I.truncate_ids(c, 4)) == [2, 12, 13, 3]


def test_cut_at_eos(spark):
    assert _one(spark, [12, 3, 13], I.cut_at_eos) == [12]
    assert _one(spark, [12, 13], I.cut_at_eos) == [12, 13]
    assert _one(spark, [3, 13], I.cut_at_eos) == []


def test_strip_special(spark):
    assert _one(spark, [2, 12, 1, 13, 3, 0], I.strip_special_ids) == [12, 13]


def test_wrapping(spark):
    assert _one(spark, [], I.wrap_special) == [2, 3]
    assert _one(spark, [7], lambda c: I.wrap_special_pair(c, c)) == [2, 7, 3, 2, 7, 3]


def test_decoder_sides(spark):
    assert _one(spark, [2, 3, 0], I.decoder_input) == [2, 3]
    assert _one(spark, [2, 3, 0], I.decoder_target) == [3, 0]
    assert _one(spark, [], I.decoder_input) == []


def test_masks(spark):
    assert _one(spark, [2, 0], I.target_mask) == [[False, True], [False, True]]
    assert _one(spark, [2, 5, 0], I.source_mask) == [False, False, True]
    assert _one(spark, [2, 5, 0], I.attention_mask) == [1, 1, 0]
    assert _one(spark, [2, 5, 0], I.real_token_count) == 2


def test_padding(spark):
    assert _one(spark, [2, 3], lambda c: I.pad_ids(c, F.lit(4))) == [2, 3, 0, 0]
