"""Exact set-similarity join of lines: rarity order, prefix, positional and length filters.

A line is the set of its white-space-separated words. Lines with the same set are one
class. Two classes can reach a Jaccard similarity of 4/5 only if their rarest words (a
prefix of the set in rarity order whose length follows from its size) share one word, if
their sizes differ little, and if the words behind the shared one still suffice. A word
shared by many classes of like size is not expanded into pairs: prefixes one word longer
must then share two words. What passes is verified on the whole sets. DataFrame functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.sizing import small_side
from ..plans.stages import drop_stage, write_stage

SPACE = "[ \\x09-\\x0D]+"
BUCKETS = 1 << 16  # rarity is counted per hash bucket of words, a table of fixed size
DENSE = 200  # a key that starts more classes than this gets a further word; with two words, leaders come first
_HASH_BITS = 56  # of a code; the rank (below 128 for any 63-bit count) stands above them


def words_of(text: Column) -> Column:
    # Splitting at one plain character is far cheaper than at a pattern; other white space is rare.
    other = F.lit(False)
    for c in "\t\n\x0b\x0c\r":
        other = other | F.contains(text, F.lit(c))
    return F.array_remove(F.when(other, F.split(text, SPACE)).otherwise(F.split(text, " ")), "")


def _rarity(docs: DataFrame, text_col: str) -> Column:
    """``BUCKETS`` ranks (twice the log frequency of the words that hash there), as a constant array."""
    # explode_outer: for a plain explode the optimizer would cut the text a second time to skip empty arrays.
    counted = (
        docs.select(F.explode_outer(F.split(F.col(text_col), " ")).alias("w"))  # the order may be rough, not the sets
        .groupBy(F.xxhash64("w").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket"))
        .agg(F.count("*").alias("n"))
    )
    ranks = [1] * BUCKETS
    for row in counted.collect():  # at most BUCKETS rows, whatever the input
        ranks[row.bucket] = 1 + int(2 * math.log2(row.n))
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<bigint>")


def _coded(words: Column, ranks: Column) -> Column:
    """The set of words of a line, as sorted codes: the rarest words first."""
    # Two steps, or each word would be hashed twice; words that come again get no code, and codes that cannot be null
    # are sorted as plain numbers.
    rank = lambda h: F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("bigint"))
    code = lambda h: F.shiftleft(rank(h), _HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit((1 << _HASH_BITS) - 1)))
    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), code))


def _hashed(words: Column) -> Column:
    """The set of words of a line, as sorted 64-bit hashes."""
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def _parity(words: str, half: bool) -> Column:
    """64 bits, each telling whether an odd number of the set's words (or of one ``half`` of all words) hash to it."""
    one = lambda h: F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("bigint")
    bit = lambda h: F.call_function("shiftleft", one(h), h.bitwiseAND(F.lit(63)).cast("int"))
    return F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, h: acc.bitwiseXOR(bit(h)))


def _needed(size: Column | str) -> Column:
    """Words a set must share with one of at least ``size`` words to reach 4/5: ceil(4 * size / 5)."""
    return F.expr(f"({size} * 4 + 4) div 5")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later class of every pair ``(a, b)`` whose sets reach 4/5."""
    a = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"), F.col("at").alias("ta"))
    b = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"), F.col("at").alias("tb"))
    joined = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return joined.filter(9 * common >= 4 * (F.size("sa") + F.size("sb"))).select(
        F.when(F.col("ta") > F.col("tb"), F.col("a")).otherwise(F.col("b")).alias("id")
    ).distinct()


def _sets(docs: DataFrame, pairs: DataFrame, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Word sets of the classes in pairs, cut again from the document where each occurs first."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    needed = places.join(ids, "id").groupBy("at.doc_id", "at.text_hash").agg(
        F.collect_list(F.struct("id", F.col("at.line_no").alias("line_no"))).alias("wanted")
    )
    side = small_side(needed, "wanted-lines").select(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), "wanted")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"))
    held = rows.join(side, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.xxhash64("_t") == F.col("_h")))
    held = held.withColumn("_lines", F.split("_t", "\n"))
    one = held.select("doc_id", "_h", F.explode_outer(F.transform("wanted", lambda x: F.struct(
        x["id"].alias("id"), x["line_no"].alias("line_no"), F.get(F.col("_lines"), x["line_no"]).alias("line")
    ))).alias("x"))
    return one.select(
        "x.id", _hashed(words_of(F.col("x.line"))).alias("set"),
        F.struct("doc_id", F.col("_h").alias("text_hash"), "x.line_no").alias("at"),
    ).dropDuplicates(["id"])


#: Length and positional filters for the ``shared``-th common word, at the 0-based places ``pa`` and ``pb``; then
#: parities of one half of all words and of the other (all words' less the half's), which together differ in no more
#: bits than the sets differ in words, and these are at most a ninth.
_FITS = (
    "nb * 5 >= na * 4 AND na * 5 >= nb * 4 AND 9 * ({shared} + least(na - pa - 1, nb - pb - 1)) >= 4 * (na + nb)"
    " AND 9 * (bit_count(ya ^ yb) + bit_count(ya ^ yb ^ za ^ zb)) <= na + nb"
)
#: Places at which the ``shared``-th common word with any partner of at least ``partner`` words stands.
_PLACES = "(size - ((4 * (size + {partner}) + 8) div 9) + {shared})"
#: 1 for a class that asks under the key, and 2 for one that is found by it.
_ROLE = "int(own) + 2 * int(NOT own OR place < " + _PLACES.format(partner="size", shared="{shared}") + ")"
_SIDE = {"id": "", "size": "n", "place": "p", "parity": "y", "parity2": "z"}


def _side(postings: DataFrame, name: str, *more: str) -> DataFrame:
    return postings.select("code", *[F.col(c).alias(f"{short}{name}") for c, short in _SIDE.items()], *[F.col(c).alias(f"{c}_{name}") for c in more])


def _postings(classes: DataFrame) -> DataFrame:
    """One row per class and prefix word, keyed by the word and the class's size band (sizes that double).

    Partners are at most a quarter larger, so they lie in the same band or, for sizes at a
    band's upper end, in the one above, where the class is then found too (``own`` is false), at the few
    places that partners so large leave. ``last`` is the place of the one word more that a key of two words may take.
    """
    band = lambda size: F.length(F.bin(size))
    held = classes.filter("prefix IS NOT NULL").select("id", "size", "parity", "parity2", "prefix")
    own = held.withColumn("last", F.size("prefix") - 1).withColumn("_band", band(F.col("size")))
    above = held.filter(band(F.expr("size * 5 div 4")) > band(F.col("size"))).withColumn("_band", band(F.col("size")) + 1)
    above = above.withColumn("last", F.expr(_PLACES.format(partner="shiftleft(1, _band - 1)", shared=1)).cast("int")).filter("last > 0")
    keyed = lambda rows, own: rows.select(
        "id", "size", "parity", "parity2", "last", "_band", F.posexplode_outer(F.slice("prefix", F.lit(1), F.col("last"))).alias("place", "word")
    ).select("id", "size", "parity", "parity2", "last", F.lit(own).alias("own"), "place", F.xxhash64("word", "_band").alias("code"))
    return keyed(own, True).unionByName(keyed(above, False))


def _crowded(postings: DataFrame, shared: int) -> DataFrame:
    """Keys that more than ``DENSE`` classes can be found by."""
    found = postings.filter(_ROLE.format(shared=shared) + " > 1").groupBy("code").agg(F.count("*").alias("m"))
    return small_side(found.filter(f"m > {DENSE}").select("code"), "dense-words")


def _longer(postings: DataFrame, classes: DataFrame) -> DataFrame:
    """Keys of two words: each later place of a prefix longer by one follows the first."""
    # Prefixes come only now; beside all postings they would be most of the bytes.
    rows = small_side(postings, "crowded-places").join(classes.select("id", "prefix"), "id")
    rows = rows.filter("place < last").withColumn("next", F.explode(F.sequence(F.col("place") + 1, F.col("last"))))
    return rows.select("id", "size", "parity", "parity2", "own", F.col("next").alias("place"), F.xxhash64("code", F.get("prefix", F.col("next"))).alias("code"))


def _pairs(postings: DataFrame, shared: int) -> DataFrame:
    roles = postings.withColumn("role", F.expr(_ROLE.format(shared=shared)))
    x, y = _side(roles, "a", "role"), _side(roles, "b", "role")
    # The smaller set is found through its shorter index prefix; of equal sizes, the one with the smaller id.
    # The roles are tested as one sum over both sides, so the test stays in the join and both sides share one shuffle.
    found = x.join(y, "code").filter("(nb < na OR (nb = na AND b < a)) AND (role_a & 1) + (role_b & 2) = 3").filter(_FITS.format(shared=shared))
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text_hash, lines)``: the 0-based numbers of the lines to remove, for documents that have any.

    A line goes when an earlier line of the table has a word set with Jaccard similarity of
    4/5 or more (earlier by doc_id, text hash, line number; null ids first). Earlier lines count
    whether or not they go themselves, so the result does not depend on any processing order.

    Lines without words always stay. Null texts have no lines. Rows that repeat an id and a
    text are one document. Sets are told apart by 64-bit hashes. An empty table gives an empty
    result.

    A rare word shared by more than ``DENSE`` classes of like size (lines of common words) is
    not expanded into pairs: its classes must share a second word of their prefixes, made one
    longer, which leaves no pair out. Two words shared by as many (a family of near copies) have
    their classes first compared with the family's earliest class, and only classes that nothing
    earlier has matched go on.
    """
    ranks = _rarity(docs, text_col)
    # The hash stands below the explode, or each line would hash the whole text again.
    whole = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.split(F.col(text_col), "\n").alias("_lines"))
    lines = whole.select("doc_id", "text_hash", F.posexplode_outer("_lines").alias("line_no", "line"))
    # One word more than the prefix, for keys of two words.
    kept = F.when(F.col("size") >= 4, F.slice("set", F.lit(1), F.col("size") - _needed("size").cast("int") + 2))
    keyed = lines.select("doc_id", "text_hash", "line_no", _coded(words_of(F.col("line")), ranks).alias("set")).withColumn("size", F.size("set")).select(
        "doc_id", "text_hash", "line_no", F.xxhash64("set").alias("key"), "size", _parity("set", True).alias("parity"), _parity("set", False).alias("parity2"), kept.alias("prefix")
    )
    written, wide = write_stage(keyed, "lines")
    written = written.filter("size > 0")  # only now: a filter above would cut every line twice
    grouped = written.groupBy("key").agg(
        F.min(F.struct("doc_id", "text_hash", "line_no")).alias("at"), F.count("*").alias("n"),
        F.first("size").alias("size"), F.first("parity").alias("parity"), F.first("parity2").alias("parity2"), F.first("prefix").alias("prefix"),
    )
    # Short ids in place of keys: they compress in the shuffles of the join.
    classes, _ = write_stage(grouped.withColumn("id", F.monotonically_increasing_id()), "line-classes")
    # From here on a line is its key; the copy with prefixes and parities would only take room beside the postings.
    occurrences, _ = write_stage(written.select("doc_id", "text_hash", "line_no", "key"), "line-keys")
    drop_stage(docs.sparkSession, wide)
    postings = _postings(classes)
    places = classes.select("id", "at")
    dense = _crowded(postings, 1)
    pairs, _ = write_stage(_pairs(postings.join(dense, "code", "left_anti"), 1), "line-pairs")
    longer, long_path = write_stage(_longer(postings.join(dense, "code"), classes), "long-postings")
    dense = _crowded(longer, 2)
    asked, _ = write_stage(_pairs(longer.join(dense, "code", "left_anti"), 2), "line-pairs")
    crowded, _ = write_stage(longer.join(dense, "code").join(places, "id"), "dense-postings")
    drop_stage(docs.sparkSession, long_path)
    first = F.min(F.struct("at", "id", "size", "place", "parity", "parity2")).alias("first")
    leaders = crowded.filter("own").groupBy("code").agg(first).select("code", "first.*")
    led = _side(crowded, "a").join(_side(leaders, "b"), "code").filter("a <> b").filter(_FITS.format(shared=2))
    led, _ = write_stage(led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "leader-pairs")
    asked = pairs.unionByName(asked).unionByName(led).distinct()
    sets, _ = write_stage(_sets(docs, asked, places, id_col, text_col), "line-sets")
    gone, _ = write_stage(_verified(asked, sets), "later-classes")
    if not crowded.isEmpty():
        left = crowded.join(gone, "id", "left_anti")
        x, y = _side(left, "a", "at", "own"), _side(crowded, "b", "at", "own")
        rest = x.join(y, "code").filter("a <> b AND at_b < at_a AND (own_a OR own_b)").filter(_FITS.format(shared=2)).select("a", "b").distinct()
        rest, _ = write_stage(rest, "rest-pairs")
        sets, _ = write_stage(_sets(docs, rest, places, id_col, text_col), "line-sets")
        gone = gone.unionByName(_verified(rest, sets)).distinct()
    marked = classes.select("id", "key", "at", "n").join(gone.withColumn("_gone", F.lit(True)), "id", "left")
    special = marked.filter("n > 1 OR _gone").select("key", "at", "_gone")
    hit = occurrences.select("doc_id", "text_hash", "line_no", "key").join(special, "key").filter(
        F.coalesce(F.col("_gone"), F.lit(False)) | (F.struct("doc_id", "text_hash", "line_no") > F.col("at"))
    )
    return hit.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("line_no")).alias("lines"))


def remove_later_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; from the texts, lines that repeat an earlier line are removed.

    Adds ``n_lines`` and ``n_removed``. A document keeps its row even when no line is left
    (its text is then empty). Null texts stay null with 0 lines. See ``later_lines``.
    """
    side = small_side(later_lines(docs, id_col, text_col), "later-lines").select(
        F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h"), F.col("lines").alias("_gone")
    )
    text = F.col(text_col)
    joined = docs.withColumn("_lines", F.split(text, "\n")).join(side, F.col(id_col).eqNullSafe(F.col("_i")) & (F.xxhash64(text) == F.col("_h")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    left = F.transform(stay, lambda i: F.get("_lines", i))
    rebuilt = F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(text.isNull(), 0).otherwise(F.size("_lines")).cast("long")
    added = {"n_lines": n_lines, "n_removed": F.coalesce(F.size("_gone"), F.lit(0)).cast("long")}
    return joined.select(
        *[rebuilt.alias(c) if c == text_col else docs[c] for c in docs.columns if c not in added],
        *[c.alias(name) for name, c in added.items()],
    )
