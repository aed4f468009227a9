"""A corpus pipeline over ``documents``: language, lines, near copies, benchmark leaks, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept.
All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinline.llm import bpe, decontaminate, language_id, line_dedup, minhash_dedup
from twinline.llm.queries import read, vocabulary
from twinline.plans.stages import write_stage

#: A document whose n-grams are known to its language in a smaller share than this has no language we know.
LEAST_SCORE = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a known language; letterless and null texts go."""
    named = language_id.identify_languages(docs.withColumn("_all", F.struct(*docs.columns)))
    known = named.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.select("_all.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat an earlier line; ``n_chars`` follows the text."""
    cleaned = line_dedup.remove_later_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
        cleaned = cleaned.withColumn("n_chars", changed)
    return cleaned.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies; of equal texts without words, such as emptied copies, the smallest id."""
    kept = minhash_dedup.drop_near_duplicates(docs)
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(True))
    smallest = F.min_by(F.struct(*kept.columns), F.coalesce(F.col("doc_id"), F.lit((1 << 63) - 1)))
    wordless = kept.filter(~worded).groupBy(F.col("text").alias("_t")).agg(smallest.alias("_all")).select("_all.*")
    return kept.filter(worded).unionByName(wordless)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window."""
    marked = decontaminate.mark_contaminated(docs.withColumn("_all", F.struct(*docs.columns)), read(spark, sf_dir, "benchmark"))
    return marked.filter(~F.col("contaminated")).select("_all.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.digests(bpe.encode_texts(docs.select("doc_id", "text"), vocabulary()), "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("minhash_near_dedup", keep_one_of_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe", encode),
]

#: Learned filters, sketches and token ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


PIPELINE_QUERIES = {"pipeline": run}
PIPELINE_SQL: dict[str, str] = {}
