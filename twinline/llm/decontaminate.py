"""Benchmark decontamination by winnowing: share fingerprints, then extend the hits.

Of every ``GUARD`` consecutive ``GRAM``-word hashes of a text the smallest is a fingerprint.
Two texts that share ``WINDOW = GRAM + GUARD - 1`` consecutive words share all hashes of one
such run and hence a fingerprint, so no shared window is missed. Documents without a shared
fingerprint end there; in the others the shared grams are located and extended to whole
windows, which are compared word by word. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import small_side
from ..plans.stages import write_stage

WINDOW, GRAM = 10, 5
GUARD = WINDOW - GRAM + 1
# What separates words, before and after A-Z are made small.
SEPARATORS_RAW = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def raw_words(text: Column) -> Column:
    return F.array_remove(F.split(text, SEPARATORS_RAW), "")


def exact_words(text: Column) -> Column:
    """Words with A-Z (and no other letter) made small."""
    return raw_words(F.translate(text, UPPER, LOWER))


def _hashes(words: Column) -> Column:
    """Word hashes that ignore the case of all letters: a coarser test, so nothing is lost by it."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def _grams(hashes: str, n: int) -> Column:
    """Hash of every run of ``n`` words, by its start."""
    count = F.size(hashes) - n + 1
    at = lambda i: F.xxhash64(F.lit(n), *[F.get(F.col(hashes), i + j) for j in range(n)])
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), at)).otherwise(F.array().cast("array<bigint>"))


def _winnowed(grams: str) -> Column:
    """Distinct window minima; texts with fewer than ``GUARD`` grams have no whole window."""
    count = F.size(grams) - GUARD + 1
    low = lambda i: F.least(*[F.get(F.col(grams), i + j) for j in range(GUARD)])
    return F.when(count > 0, F.array_distinct(F.transform(F.sequence(F.lit(0), count - 1), low))).otherwise(F.array().cast("array<bigint>"))


def _joined(words: str, start: Column, n: Column | int) -> Column:
    """The ``n`` words from the 0-based ``start``; words hold no space, so the string is exact."""
    return F.array_join(F.slice(F.col(words), start + 1, F.lit(n) if isinstance(n, int) else n), " ")


def _windows(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """Every window of the benchmark: ``item_id, n, start, window`` plus the hash of its item's grams."""
    items = benchmark.select(F.col(item_col).alias("item_id"), exact_words(F.col(text_col)).alias("w"))
    items = items.filter("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(WINDOW)))
    return items.select("item_id", "w", "n", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("n"))).alias("start")).select(
        "item_id", "n", _joined("w", F.col("start"), F.col("n")).alias("window")
    )


def contamination(
    docs: DataFrame, benchmark: DataFrame,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """``(doc_id, text_hash, n_hit, items)`` for the documents that contain a benchmark window.

    A window is ``WINDOW`` consecutive words of an item, or all words of a shorter item.
    ``n_hit`` counts the document's words inside any occurrence of any window, ``items`` is the
    sorted list of ids (as strings) of the items whose windows occur.

    Null and wordless texts have no words and no windows. Rows that repeat an id and a text
    are one document; items that repeat an id are one item; an item with a null id marks words
    but is not listed. Empty tables give an empty result. Items of less than ``WINDOW`` words
    are looked up by the hash of all their words, one pass for each length that occurs (at most
    nine), since winnowing promises nothing below a window.
    """
    windows, _ = write_stage(_windows(benchmark, item_col, item_text_col), "windows")
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())  # at most WINDOW values
    cut = windows.withColumn("h", _hashes(F.split("window", " ")))
    parts = []
    if WINDOW in lengths:
        own = cut.filter(F.col("n") == WINDOW).withColumn("g", _grams("h", GRAM))
        parts.append(own.select(F.array_min("g").alias("f")))  # a window of the item is one run of GUARD grams
    for n in lengths:
        if n < WINDOW:
            parts.append(cut.filter(F.col("n") == n).select(F.get(_grams("h", n), F.lit(0)).alias("f")))
    if not parts:
        return docs.limit(0).select(
            F.col(id_col).alias("doc_id"), F.lit(0).cast("long").alias("text_hash"),
            F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"),
        )
    prints = parts[0]
    for part in parts[1:]:
        prints = prints.unionByName(part)
    prints = small_side(prints.distinct(), "item-prints")

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    # explode_outer: for a plain explode the optimizer would compute the arrays a second time to skip empty ones.
    hashed = rows.withColumn("h", _hashes(raw_words(F.col("text"))))
    hashed = hashed.withColumn("g", _grams("h", GRAM)) if WINDOW in lengths else hashed
    sets = [_winnowed("g")] if WINDOW in lengths else []
    sets += [F.array_distinct(_grams("h", n)) for n in lengths if n < WINDOW]
    drawn = hashed.select("doc_id", "text_hash", F.explode_outer(F.concat(*sets)).alias("f"))
    hits = drawn.join(prints, "f", "left_semi").select("doc_id", "text_hash", "f").distinct()
    hits, _ = write_stage(hits, "shared-prints")
    shared = small_side(
        hits.groupBy("doc_id", "text_hash").agg(F.count("*").alias("_n")).select(
            F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")), "suspects"
    )
    suspects = rows.join(shared, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left_semi")
    suspects = suspects.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", exact_words(F.col("text")).alias("w"))
    suspects, _ = write_stage(suspects, "suspect-words")

    # Where the shared grams stand; around each, all windows that could hold it.
    starts = []
    base = suspects.withColumn("h", _hashes(F.col("w")))
    for n in lengths:
        size = GRAM if n == WINDOW else n
        grams = base.withColumn("g", _grams("h", size)).select("doc_id", "text_hash", F.size("w").alias("words"), "g")
        at = grams.select("doc_id", "text_hash", "words", F.posexplode_outer("g").alias("p", "f"))  # no array in the rows
        at = at.join(prints, "f", "left_semi")
        first, last = F.greatest(F.lit(0), F.col("p") - (n - size)), F.least(F.col("p"), F.col("words") - n)
        at = at.withColumn("first", first).withColumn("last", last).filter("first <= last")
        starts.append(at.select("doc_id", "text_hash", F.lit(n).alias("n"), F.explode(F.sequence("first", "last")).alias("start")).distinct())
    found = starts[0]
    for more in starts[1:]:
        found = found.unionByName(more)
    lists = found.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("n", "start")).alias("tries"))
    tries = lists.select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "tries")
    spelled = suspects.join(tries, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h"))).select(
        "doc_id", "text_hash",
        F.explode(F.transform("tries", lambda x: F.struct(
            x["n"].alias("n"), x["start"].alias("start"), _joined("w", x["start"], x["n"]).alias("window")))).alias("x"),
    ).select("doc_id", "text_hash", "x.*")
    known = small_side(windows.select("n", "window").distinct(), "known-windows")
    real, _ = write_stage(spelled.join(known, ["n", "window"], "left_semi"), "occurrences")
    covered = real.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("spans"))
    # Union of the spans, walked once in order of their starts.
    step = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["n"] - F.greatest(x["start"], acc["end"]))).cast("long").alias("n"),
        F.greatest(acc["end"], x["start"] + x["n"]).alias("end"),
    )
    union = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step, lambda acc: acc["n"])
    counted = covered.select("doc_id", "text_hash", union.alias("n_hit"))
    listed = (
        real.select("doc_id", "text_hash", "n", "window").distinct()
        .join(windows.filter("item_id IS NOT NULL").select("n", "window", F.col("item_id").cast("string").alias("item")).distinct(), ["n", "window"])
        .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "items")
    )
    joined = counted.join(listed, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("text_hash") == F.col("_h")), "left")
    return joined.select("doc_id", "text_hash", "n_hit", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_hit``, ``items`` and ``contaminated``. See ``contamination``."""
    found = small_side(contamination(docs, benchmark, id_col, text_col), "contamination").select(
        F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("n_hit").alias("_n"), F.col("items").alias("_items")
    )
    joined = docs.join(found, F.col(id_col).eqNullSafe(F.col("_i")) & (F.xxhash64(F.col(text_col)) == F.col("_h")), "left")
    added = {
        "n_hit": F.coalesce("_n", F.lit(0)).cast("long"),
        "items": F.coalesce("_items", F.array().cast("array<string>")),
        "contaminated": F.coalesce("_n", F.lit(0)) > 0,
    }
    return joined.select(*[docs[c] for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])


def count_words(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.size(raw_words(text))).cast("long")
