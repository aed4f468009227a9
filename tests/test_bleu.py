from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from twinline.operators import bleu


def _frame(spark, rows):
    return spark.createDataFrame([(i, h, r) for i, (h, r) in enumerate(rows)], "sent_id int, hyp string, ref string")


def _score(spark, rows):
    return bleu.corpus_bleu(_frame(spark, rows)).first()


def _brute(rows):
    correct, total, sys_len, ref_len = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in rows:
        h, r = hyp.split(), ref.split()
        sys_len += len(h)
        ref_len += len(r)
        for n in range(1, 5):
            hc = Counter(tuple(h[i:i + n]) for i in range(len(h) - n + 1))
            rc = Counter(tuple(r[i:i + n]) for i in range(len(r) - n + 1))
            total[n - 1] += sum(hc.values())
            correct[n - 1] += sum((hc & rc).values())
    if not any(correct) or not all(total):
        return 0.0
    halvings, logs = 0, 0.0
    for c, t in zip(correct, total):
        if c == 0:
            halvings += 1
        logs += math.log(100 * c / t if c else 100 / (2 ** halvings * t))
    brevity = 1.0 if sys_len >= ref_len else math.exp(1 - ref_len / sys_len)
    return brevity * math.exp(logs / 4)


def test_identical_is_100(spark):
    assert _score(spark, [("the cat sat on the mat", "the cat sat on the mat")]).bleu == pytest.approx(100)


def test_no_match_is_0(spark):
    assert _score(spark, [("a b c d e", "v w x y z")]).bleu == 0.0


def test_too_short_for_four_grams_is_0(spark):
    assert _score(spark, [("a b c", "a b c")]).bleu == 0.0


def test_empty_hypothesis(spark):
    row = _score(spark, [("", "a b c d")])
    assert row.bleu == 0.0 and row.brevity == 0.0 and row.sys_len == 0
    rows = [("", "x y"), ("a b c d e", "a b c d f")]
    assert _score(spark, rows).bleu == pytest.approx(_brute(rows))


def test_clipping_and_smoothing_by_hand(spark):
    # 1-grams: 'the' is clipped to 2 of 7, no longer n-gram matches: 1/2, 1/4 and 1/8 of a match.
    row = _score(spark, [("the the the the the the the", "the cat sat on the mat now")])
    expected = math.exp((math.log(100 * 2 / 7) + math.log(100 / (2 * 6)) + math.log(100 / (4 * 5)) + math.log(100 / (8 * 4))) / 4)
    assert row.bleu == pytest.approx(expected)


def test_short_output_is_penalised(spark):
    row = _score(spark, [("a b c d", "a b c d e f g h")])
    assert row.brevity == pytest.approx(math.exp(1 - 8 / 4)) and row.bleu == pytest.approx(100 * math.exp(-1))


@pytest.mark.parametrize("seed", range(4))
def test_random_corpora_match_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(30):
        ref = [rng.choice("abcdef") for _ in range(rng.randint(0, 12))]
        hyp = [w for w in ref if rng.random() > 0.2] + [rng.choice("abcxyz") for _ in range(rng.randint(0, 2))]
        rows.append((" ".join(hyp), " ".join(ref)))
    assert _score(spark, rows).bleu == pytest.approx(_brute(rows))


def test_alignment_and_caps(spark):
    hyps = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "sent_id int, hyp string")
    refs = spark.createDataFrame([(2, "B"), (1, "A"), (4, "D")], "sent_id int, ref string")
    known = hyps.filter("sent_id < 3")
    got = {(r.sent_id, r.hyp, r.ref) for r in bleu.align_hyp_ref(known, refs).collect()}
    assert got == {(1, "a", "A"), (2, "b", "B"), (4, "", "D")}
    for bad_hyps, bad_refs in ((hyps, refs), (known.union(known), refs), (known, refs.union(refs))):
        with pytest.raises(Exception, match="expected for sentence"):
            bleu.align_hyp_ref(bad_hyps, bad_refs).collect()
    assert [r.sent_id for r in bleu.missing_references(hyps, refs).collect()] == [3]
    good, bad = ("a b c d e", "a b c d e"), ("q", "z z z z z")
    df = spark.createDataFrame([(0, *good, 0), (1, *bad, 1)], "sent_id int, hyp string, ref string, batch_id int")
    assert bleu.corpus_bleu_capped(df, 1).first().bleu == pytest.approx(100)
    assert bleu.corpus_bleu_capped(df).first().bleu < 100


def test_texts_are_not_aggregated_and_ngrams_do_not_become_rows(spark):
    hyps = spark.createDataFrame([(i, "a b c d e a b") for i in range(20)], "sent_id int, hyp string")
    refs = spark.createDataFrame([(i, "a b c d f a b") for i in range(20)], "sent_id int, ref string")
    aligned = bleu.align_hyp_ref(hyps, refs)
    plan = bleu.corpus_bleu(aligned)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Generate") == plan.count("Generate inline(array(struct(n")
    assert all("sent_id" in line or "SinglePartition" in line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line)
    # Long runs of one word are clipped to the smaller count.
    row = bleu.bleu_ngram_stats(spark.createDataFrame([(1, "z " * 3000, "z " * 1000)], "sent_id int, hyp string, ref string")).filter("n = 1").first()
    assert (row.correct, row.total, row.ref_total) == (1000, 3000, 1000)
