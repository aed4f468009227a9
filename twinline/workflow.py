"""The usual chains of operators: prepare training batches, translate a file, score a split."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.ids import cut_at_eos, truncate_ids
from .functions.text import SOS, strip_text
from .operators.batching import build_batches
from .operators.bleu import align_hyp_ref, corpus_bleu
from .operators.codec import decode, encode
from .operators.map_lines import map_lines
from .operators.pairs import interleave_lines, merge_train_extra
from .operators.search import beam_search, greedy_decode
from .operators.vocab import Vocabulary
from .plans.stages import new_path, write_stage
from .sources.lines import read_numbered_lines, write_translations
from .sources.pairs import ExtraSource, read_extra, read_pairs
from .sources.vocab_store import get_or_train_vocab


@dataclass(frozen=True)
class Prepared:
    pairs: DataFrame
    encoded: DataFrame
    batches: DataFrame
    vocabulary: Vocabulary


def encode_pairs(
    pairs: DataFrame, vocabulary: Vocabulary, max_src_len: int = 128, max_tgt_len: int = 128
) -> DataFrame:
    """``(pair_id, split, origin, src_ids, tgt_ids)``, each side cut to its length."""
    encoded = encode(pairs, vocabulary, {"src": "src_ids", "tgt": "tgt_ids"})
    return encoded.select(
        "pair_id",
        "split",
        "origin",
        truncate_ids(F.col("src_ids"), max_src_len).alias("src_ids"),
        truncate_ids(F.col("tgt_ids"), max_tgt_len).alias("tgt_ids"),
    )


def prepare_data(
    spark: SparkSession,
    pairs_path: str,
    vocab_path: str,
    encoded_path: str | None = None,
    fmt: str = "parquet",
    registry: Mapping[str, ExtraSource] | None = None,
    extra: str | None = None,
    extra_cap: int | None = None,
    vocab_size: int = 16_000,
    batch_size: int = 128,
    max_src_len: int = 128,
    max_tgt_len: int = 128,
    force_retrain: bool = False,
    seed: int | str = 0,
) -> Prepared:
    """Load, merge, learn or load the vocabulary, encode once, and batch.

    Extra pairs join the train split only, and the vocabulary is learned from that split.
    Encoded pairs are stored, by split, since every epoch reads them.
    """
    pairs = read_pairs(spark, pairs_path, fmt)
    if extra is None:
        pairs = pairs.withColumn("origin", F.lit("base"))
    else:
        pairs = merge_train_extra(pairs, read_extra(spark, registry or {}, extra, extra_cap))
    vocabulary = get_or_train_vocab(interleave_lines(pairs), vocab_path, force_retrain, vocab_size)
    path = encoded_path or new_path(spark, "encoded-pairs")
    encode_pairs(pairs, vocabulary, max_src_len, max_tgt_len).write.partitionBy("split").parquet(path)
    encoded = spark.read.parquet(path)
    return Prepared(pairs, encoded, build_batches(encoded, batch_size, seed), vocabulary)


def translate_file(
    spark: SparkSession, input_path: str, output_path: str, translate: Callable[[str], str]
) -> str:
    """Output line i belongs to input line i; blank lines stay blank."""
    return write_translations(map_lines(read_numbered_lines(spark, input_path), translate), output_path)


#: From ``(sent_id, src_ids)`` to next-token scores ``(sent_id, [step,] prev_id, next_id, logp)``, as a stored model gives them.
Scorer = Callable[[DataFrame], DataFrame]


def _start_of(encoded: DataFrame) -> DataFrame:
    return encoded.select("sent_id", F.array(F.lit(SOS)).alias("ids"))


def translate_lines(
    lines: DataFrame,
    vocabulary: Vocabulary,
    scorer: Scorer,
    beam_width: int = 5,
    max_len: int = 128,
    alpha: float = 0.6,
    n_best: int = 1,
) -> DataFrame:
    """``(line_no, line)`` to ``(line_no, rank, text, lp_score)``: encode, search by beam, decode.

    Every line has a row of rank 1; a blank or null line stays blank, with a null score, and
    never meets the scorer. Further ranks follow up to ``n_best``. The ids of a line are
    written once, as the scorer and the search both read them.
    """
    numbered = lines.select(F.col("line_no").alias("sent_id"), F.coalesce(strip_text(F.col("line")), F.lit("")).alias("line"))
    worded = numbered.filter(F.col("line") != "")
    encoded, _ = write_stage(encode(worded, vocabulary, {"line": "src_ids"}).select("sent_id", "src_ids"), "encoded-lines")
    found = beam_search(_start_of(encoded), scorer(encoded), beam_width, max_len, alpha, n_best=n_best)
    texts = found.select("sent_id", "rank", decode(F.col("ids"), vocabulary.tokens()).alias("text"), "lp_score")
    every = numbered.select("sent_id").join(texts, "sent_id", "left")
    return every.select(
        F.col("sent_id").alias("line_no"), F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("text", F.lit("")).alias("text"), "lp_score"
    )


def evaluate_split(
    pairs: DataFrame,
    vocabulary: Vocabulary,
    scorer: Scorer,
    split: str = "test",
    max_len: int = 128,
    max_src_len: int | None = None,
    max_tgt_len: int | None = None,
) -> DataFrame:
    """Corpus BLEU of a split: encode, decode greedily from the scores, compare with the references.

    References go through encoding and decoding as well, so both sides are cut alike; sides
    are cut to a length only where one is given.
    """
    own = pairs.filter(F.col("split") == split).select(F.col("pair_id").alias("sent_id"), "src", "tgt")
    encoded = encode(own, vocabulary, {"src": "src_ids", "tgt": "tgt_ids"})
    for column, most in (("src_ids", max_src_len), ("tgt_ids", max_tgt_len)):
        if most is not None:
            encoded = encoded.withColumn(column, truncate_ids(F.col(column), most))
    encoded, _ = write_stage(encoded.select("sent_id", "src_ids", "tgt_ids"), "encoded-split")
    found = greedy_decode(_start_of(encoded), scorer(encoded.select("sent_id", "src_ids")), max_len)
    return score_ids(found, encoded.select("sent_id", F.col("tgt_ids").alias("ids")), vocabulary)


def score_ids(hyp_ids: DataFrame, ref_ids: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Corpus BLEU of ``(sent_id, ids)`` against ``(sent_id, ids)``, both decoded alike."""
    tokens = vocabulary.tokens()
    hyps = hyp_ids.select("sent_id", decode(cut_at_eos(F.col("ids")), tokens).alias("hyp"))
    refs = ref_ids.select("sent_id", decode(F.col("ids"), tokens).alias("ref"))
    return corpus_bleu(align_hyp_ref(hyps, refs))
