"""A user's own sentence-to-sentence function over numbered lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.text import strip_text


def map_lines(lines: DataFrame, fn: Callable[[str], str]) -> DataFrame:
    """``(line_no, line)`` to ``(line_no, text)``; blank lines bypass ``fn`` and stay blank.

    ``line_no`` travels with each row, so the order can be restored by any later sort.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch["text"] = [fn(line) if line else "" for line in batch["text"]]
            yield batch

    stripped = lines.select(
        F.col("line_no").cast("long").alias("line_no"),
        F.coalesce(strip_text(F.col("line")), F.lit("")).alias("text"),
    )
    return stripped.mapInPandas(run, "line_no long, text string")
