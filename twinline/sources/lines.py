"""Text files: corpus lines, numbered lines, translations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession, Window, functions as F

from ..functions.text import EXTRA_LINE_BREAKS, strip_text
from ..operators.pairs import LINE_ORDER, interleave_lines
from ..plans.sizing import small_side
from ..plans.stages import write_stage


def write_corpus(
    pairs: DataFrame, path: str, splits: Sequence[str] = ("train",)
) -> tuple[str, int]:
    """Write the interleaved lines in order; return the path and the line count.

    The sort is a range sort, so part files follow one another in order and no
    task sees more than its range.
    """
    seen = Observation("corpus_lines")
    ordered = interleave_lines(pairs, splits).orderBy(*LINE_ORDER).select("line")
    # Observed above the sort: what lies below it runs twice, once for the range bounds.
    ordered.observe(seen, F.count("*").alias("n")).write.text(path)
    return path, seen.get["n"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Stripped lines, blank ones skipped, as ``(line)``."""
    stripped = spark.read.text(path).select(strip_text(F.col("value")).alias("line"))
    return stripped.filter(F.length("line") > 0)


def read_numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Every line, blank ones too, with its 1-based number, as ``(line_no, line)``.

    Scan tasks may hold several file blocks in any order, so the number is built
    from the order of rows inside a block plus the lines of all earlier blocks.
    The scan is written once with its row ids (another scan could cut blocks
    differently when the cluster has grown); no row is shuffled.
    """
    pieces = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.explode(F.split("value", EXTRA_LINE_BREAKS)).alias("line"),
        )
        .withColumn("_row", F.monotonically_increasing_id())
    )
    stage, _ = write_stage(pieces, "numbered-lines")
    blocks = stage.groupBy("_file", "_block").agg(
        F.count("*").alias("_lines"), F.min("_row").alias("_first")
    )
    # One row per file block: thousands of blocks per terabyte, so one task orders them.
    folder = F.regexp_extract("_file", r"^(.*)/", 1)
    part = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1)
    earlier = Window.orderBy(folder, F.length(part), "_file", "_block")
    offsets = blocks.withColumn(
        "_shift", F.sum("_lines").over(earlier) - F.col("_lines") - F.col("_first") + 1
    ).drop("_lines", "_first")
    return stage.join(small_side(offsets, "block-offsets"), ["_file", "_block"]).select(
        (F.col("_row") + F.col("_shift")).alias("line_no"), "line"
    )


def write_translations(lines: DataFrame, path: str, text: str = "text") -> str:
    """Write ``text`` in ``line_no`` order, one output line per row, blank for null."""
    lines.orderBy("line_no").select(F.coalesce(text, F.lit("")).alias("value")).write.text(path)
    return path
