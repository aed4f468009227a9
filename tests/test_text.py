from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from twinline.functions import text as T


def _one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    "raw",
    ["\xa0 a b\t\n", "  ", "", "x", "\x1ca\x1f", "  a　", "a\nb\n", "​a​"],
)
def test_strip_is_the_python_rule(spark, raw):
    assert _one(spark, raw, T.strip_text) == raw.strip()


def test_normalize_is_per_character(spark):
    assert _one(spark, "ΟΔΟΣ ÄÖÜ ẞß", T.normalize) == "οδοσ äöü ßß"


def test_pre_tokens(spark):
    assert _one(spark, "don't a_b №5 ...!?", T.pre_tokenize) == ["don", "'", "t", "a_b", "№", "5", "...!?"]
    assert _one(spark, "", T.pre_tokenize) == []


def test_special_tokens_in_raw_text(spark):
    assert _one(spark, "A..[EOS]b [eos] [[PAD]x", T.words_for_encoding) == [
        "a", "..", "[EOS]", "b", "[", "eos", "]", "[", "[PAD]", "x"
    ]


@pytest.mark.parametrize(
    ("raw", "tokens"),
    [
        ("Hello, world!", "Hello , world !"),
        ("1,000.50 is 3-4 or a-b.", "1,000.50 is 3 - 4 or a-b ."),
        ("&quot;x&quot; &lt;b&gt; &amp;", '" x " < b > &'),
        ("a<skipped>b-\nc\nd", "ab c d".replace("b c", "bc")),
        ("(a) $5 100%", "( a ) $ 5 100 %"),
        ("", ""),
    ],
)
def test_13a(spark, raw, tokens):
    assert " ".join(_one(spark, raw, T.bleu_tokenize_13a)) == tokens


def test_lowercase_and_words_match_the_tokenizers_package(spark):
    pytest.importorskip("tokenizers")
    from tokenizers import normalizers, pre_tokenizers

    samples = [
        "Zwei junge weiße Männer sind im Freien!", "İstanbul ΑΣ Σ", "naïve é a‍b", "日本語 テスト。",
        "हिन्दी शब्द", "a b c", "x²+½=٣", "🙂🙂 ok", "_a_ -b- 'c'", "ǅ ﬁ ſ",
    ]
    lower, cut = normalizers.Lowercase(), pre_tokenizers.Whitespace()
    for sample in samples:
        expected = [w for w, _ in cut.pre_tokenize_str(lower.normalize_str(sample))]
        got = _one(spark, sample, lambda c: T.pre_tokenize(T.normalize(c)))
        assert got == expected, sample
