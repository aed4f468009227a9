from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinline import workflow
from twinline.sources.pairs import ExtraSource


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    rows = [(i, "train" if i < 20 else "validation" if i < 24 else "test", f"The dog {i} runs", f"Der Hund {i} rennt schnell") for i in range(28)]
    spark.createDataFrame(rows, "pair_id long, split string, src string, tgt string").write.partitionBy("split").parquet(f"{root}/pairs")
    extra = [(i, f" a cat {i} ", f"eine Katze {i}" if i % 3 else " ") for i in range(12)]
    spark.createDataFrame(extra, "pair_id long, en string, de string").select("pair_id", F.struct("en", "de").alias("translation")).write.parquet(f"{root}/extra")
    return root


def test_prepare(spark, stored, tmp_path):
    registry = {"cats": ExtraSource(f"{stored}/extra")}
    kwargs = dict(registry=registry, extra="cats", extra_cap=6, vocab_size=60, batch_size=8, max_src_len=5, max_tgt_len=7)
    data = workflow.prepare_data(spark, f"{stored}/pairs", f"{tmp_path}/vocab", **kwargs)
    assert data.encoded.filter("split = 'train'").count() == 26
    assert data.batches.filter("split = 'train'").count() == 24
    plain = workflow.prepare_data(spark, f"{stored}/pairs", f"{tmp_path}/vocab", vocab_size=60, max_src_len=5, max_tgt_len=7)
    held_out = lambda d: sorted(map(tuple, d.encoded.filter("split <> 'train'").select("pair_id", "split", "src_ids", "tgt_ids").collect()))
    assert held_out(data) == held_out(plain) and len(held_out(data)) == 8
    assert data.encoded.filter(F.size("src_ids") > 5).count() == 0
    assert data.encoded.filter(F.element_at("tgt_ids", -1) != 3).count() == 0


def test_prepare_with_an_unknown_source(spark, stored, tmp_path):
    with pytest.raises(ValueError):
        workflow.prepare_data(spark, f"{stored}/pairs", f"{tmp_path}/vocab", extra="nowhere")


def test_translate_file(spark, tmp_path):
    (tmp_path / "in.txt").write_text("a b\n\n c \n", encoding="utf-8")
    out = workflow.translate_file(spark, str(tmp_path / "in.txt"), str(tmp_path / "out"), str.upper)
    from twinline.sources.lines import read_numbered_lines

    assert [r.line for r in read_numbered_lines(spark, out).orderBy("line_no").collect()] == ["A B", "", "C"]


def test_scoring_a_copy_gives_100(spark, stored, tmp_path):
    data = workflow.prepare_data(spark, f"{stored}/pairs", f"{tmp_path}/vocab", vocab_size=40)
    test = data.encoded.filter("split = 'test'").select(F.col("pair_id").alias("sent_id"), F.col("tgt_ids").alias("ids"))
    assert workflow.score_ids(test, test, data.vocabulary).first().bleu == pytest.approx(100)


def _copying(encoded):
    """Scores that copy the source, step by step."""
    both = F.arrays_zip(F.col("src_ids").alias("prev_id"), F.slice("src_ids", F.lit(2), F.size("src_ids")).alias("next_id"))
    steps = encoded.select("sent_id", F.posexplode(both).alias("step", "p")).select("sent_id", "step", "p.*").filter("next_id IS NOT NULL")
    return steps.withColumn("logp", F.lit(-0.1))


@pytest.fixture(scope="module")
def letters(spark):
    from twinline.operators import vocab as V

    return V.train_bpe(V.word_counts(spark.createDataFrame([("ab ab cd ef gh",)], "line string")), 13)


def test_lines_are_translated_and_blank_ones_stay(spark, letters):
    lines = spark.createDataFrame([(1, "ab cd"), (2, "  "), (3, None), (4, "AB zz ab"), (5, "ab cd ef gh")], "line_no int, line string")
    met = []

    def scorer(encoded):
        met.extend(r.sent_id for r in encoded.collect())
        return _copying(encoded)

    rows = workflow.translate_lines(lines, letters, scorer, beam_width=2, max_len=6).orderBy("line_no").collect()
    # The unknown letters are dropped when decoding; a line longer than six tokens ends there.
    assert [(r.line_no, r.rank, r.text) for r in rows] == [(1, 1, "ab c d"), (2, 1, ""), (3, 1, ""), (4, 1, "ab ab"), (5, 1, "ab c d e f g")]
    assert sorted(met) == [1, 4, 5] and [r.lp_score is None for r in rows] == [False, True, True, False, False]
    assert workflow.translate_lines(lines.limit(0), letters, _copying).collect() == []


def test_alternatives_of_a_line_come_ranked(spark, letters):
    lines = spark.createDataFrame([(1, "ab")], "line_no int, line string")
    ids = {t: i for i, t in enumerate(letters.tokens())}
    table = [(1, 2, ids["ab"], -0.1), (1, 2, ids["c"], -0.2), (1, ids["ab"], 3, -0.1), (1, ids["c"], 3, -0.1)]
    scorer = lambda encoded: encoded.sparkSession.createDataFrame(table, "sent_id int, prev_id int, next_id int, logp double")
    rows = workflow.translate_lines(lines, letters, scorer, beam_width=3, max_len=4, n_best=2).orderBy("rank").collect()
    assert [(r.rank, r.text) for r in rows] == [(1, "ab"), (2, "c")]


def test_a_split_is_evaluated_from_its_text(spark, letters):
    rows = [(1, "test", "ab cd ef", "ab cd ef"), (2, "test", "gh ab cd", "gh ab cd"), (3, "train", "ab", "zz")]
    pairs = spark.createDataFrame(rows, "pair_id int, split string, src string, tgt string")
    assert workflow.evaluate_split(pairs, letters, _copying).first().bleu == pytest.approx(100)
    short = workflow.evaluate_split(pairs, letters, _copying, max_len=4).first()
    assert short.bleu < 100 and (short.sys_len, short.ref_len) == (6, 10)
