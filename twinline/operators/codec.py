"""Text to token ids and back."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ids import attention_mask, pad_ids, strip_special_ids, truncate_ids, wrap_special
from ..functions.text import SPECIAL_TOKENS, UNK, words_for_encoding
from ..plans.joins import join_on_groups
from ..plans.sizing import small_side
from ..plans.stages import drop_stage, write_stage
from .vocab import Vocabulary

WORD_CACHE = 100_000
SLICE_ROWS = 512  # rows that are turned into ids at once: bounds a worker's memory, whatever Arrow batches hold
LONGEST_CACHED = 64
LONGEST_SHARED = 1024  # bytes of a word that is shared with all tasks


def word_encoder(vocabulary: Vocabulary) -> Callable[[Column], Column]:
    """Arrow UDF: a string of blank-separated words to the array of their ids.

    Text is normalised and cut into words by the JVM; Python only looks words up. The
    merge rules are shared with the executors (their number is bounded by the
    vocabulary), each task keeps the words it has met, and nothing is shuffled.
    """
    tokens = vocabulary.tokens()
    specials = dict(zip(SPECIAL_TOKENS, range(len(SPECIAL_TOKENS))))
    characters = {t: i for i, t in enumerate(tokens) if len(t) == 1}
    rules: dict[tuple[int, int], tuple[int, int]] = {}
    for rank, (left, right, new) in enumerate(vocabulary.merge_rules()):
        rules.setdefault((left, right), (rank, new))
    shared = vocabulary.vocab.sparkSession.sparkContext.broadcast((characters, rules, specials))
    limit, longest, rows, unknown = WORD_CACHE, LONGEST_CACHED, SLICE_ROWS, UNK

    def encode_word(word, characters, rules):
        # Best rule first, leftmost first; a queue keeps very long words from being slow.
        ids = [characters.get(c, unknown) for c in word]
        size = len(ids)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        queue = []

        def offer(i):
            j = after[i] if i >= 0 else size
            if j < size and (ids[i], ids[j]) in rules:
                rank, new = rules[ids[i], ids[j]]
                heappush(queue, (rank, i, ids[i], ids[j], new))

        for i in range(size):
            offer(i)
        while queue:
            _, i, left, right, new = heappop(queue)
            j = after[i]
            if ids[i] != left or j >= size or ids[j] != right:
                continue  # one of the two has been merged since
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[i] < size:
                before[after[i]] = i
            offer(i)
            offer(before[i])
        return [x for x in ids if x >= 0]

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        characters, rules, specials = shared.value
        met = {token: array("i", [i]) for token, i in specials.items()}
        for lines in (batch.slice(at, rows) for batch in batches for at in range(0, len(batch), rows)):
            flat, ends = array("i"), array("i", [0])
            for line in lines.to_pylist():
                for word in line.split(" ") if line else ():
                    ids = met.get(word)
                    if ids is None:
                        ids = array("i", encode_word(word, characters, rules))
                        if len(met) > limit:
                            met = {token: array("i", [i]) for token, i in specials.items()}
                        if len(word) <= longest:
                            met[word] = ids
                    flat.extend(ids)
                ends.append(len(flat))
            yield pa.ListArray.from_arrays(
                pa.Array.from_buffers(pa.int32(), len(ends), [None, pa.py_buffer(ends)]),
                pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]),
            )

    return F.arrow_udf(encode, "array<int>")


def encode(
    df: DataFrame,
    vocabulary: Vocabulary,
    columns: dict[str, str],
    max_len: int | None = None,
    add_special: bool = True,
) -> DataFrame:
    """Add an id array per text column; ``columns`` maps text column to output column.

    Ids are wrapped in SOS and EOS; a literal special token in the text keeps its own
    id; null text encodes as empty text. ``max_len`` cuts to that length, EOS kept.
    """
    to_ids = word_encoder(vocabulary)
    added = {}
    for text, out in columns.items():
        ids = to_ids(F.coalesce(F.array_join(words_for_encoding(F.col(text)), " "), F.lit("")))
        if add_special:
            ids = wrap_special(ids)
        added[out] = ids
    df = df.withColumns(added)
    if max_len is not None:
        df = df.withColumns({out: truncate_ids(F.col(out), max_len) for out in columns.values()})
    return df


def encode_words(words: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The dictionary: ``words`` with an ``ids`` array per ``word``, unwrapped."""
    return words.withColumn("ids", word_encoder(vocabulary)(F.col("word")))


def frequent_words(words: DataFrame, k: int, word: str = "words") -> list[str]:
    """About the ``k`` most frequent of the blank-separated words, by a mergeable sketch of fixed size.

    Every word that makes up more than one in ``k`` of the text is among them. Words longer
    than ``LONGEST_SHARED`` bytes are left out, which bounds the bytes of the answer.
    """
    one = words.select(F.explode(F.split(word, " ")).alias("word"))
    short = one.filter((F.col("word") != "") & (F.octet_length("word") <= LONGEST_SHARED))
    tracked = min(4 * k, 1_000_000)
    found = short.agg(F.expr(f"approx_top_k(word, {k}, {tracked})").alias("top")).first().top
    return [x.item for x in found or [] if x.item is not None]


def _placer(known: dict[str, list[int]], spark) -> Callable[[Column], Column]:
    """Arrow UDF: blank-separated words to ``ids`` of the known words and the distinct other words.

    The k-th other word stands in ``ids`` as ``-k`` (from 1), wherever it occurs.
    """
    shared, rows = spark.sparkContext.broadcast(known), SLICE_ROWS

    def place(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for lines in (batch.slice(at, rows) for batch in batches for at in range(0, len(batch), rows)):
            flat, ends, cold, cold_ends = array("i"), array("i", [0]), [], array("i", [0])
            for line in lines.to_pylist():
                others: dict[str, int] = {}
                for word in line.split(" ") if line else ():
                    ids = known.get(word)
                    if ids is None:
                        flat.append(-others.setdefault(word, len(others) + 1))
                    else:
                        flat.extend(ids)
                ends.append(len(flat))
                cold.extend(others)
                cold_ends.append(len(cold))
            offsets = lambda x: pa.Array.from_buffers(pa.int32(), len(x), [None, pa.py_buffer(x)])
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(offsets(ends), offsets(flat)), pa.ListArray.from_arrays(offsets(cold_ends), pa.array(cold, pa.string()))],
                ["ids", "others"],
            )

    return F.arrow_udf(place, "struct<ids: array<int>, others: array<string>>")


def known_word_encode(
    df: DataFrame,
    dictionary: DataFrame,
    keys: Sequence[str],
    text: str,
    hot_words: int = 50_000,
) -> DataFrame:
    """Encode by joining each word with a stored dictionary ``(word, ids)``; gives ``keys`` and ``ids``.

    The words that are frequent *in this text*, whether the dictionary has them or not, are
    found by a sketch and shared with all tasks (at most ``hot_words`` of them), where they
    become ids in place. The other words, each once per row, meet the dictionary by a shuffle
    on the word; no one of them is frequent enough to load a task. Only they are grouped by row
    again. Texts are cut once. ``keys`` must identify a row (nulls equal each other). A word
    that the dictionary lacks becomes one UNK per character; null text encodes as empty text.
    """
    spark = df.sparkSession
    cut, cut_path = write_stage(df.select(*keys, F.array_join(words_for_encoding(F.col(text)), " ").alias("words")), "cut-words")
    hot = frequent_words(cut, hot_words)
    known = {word: [SPECIAL_TOKENS.index(word)] if word in SPECIAL_TOKENS else [UNK] * len(word) for word in hot}
    if hot:
        wanted = spark.createDataFrame([(word,) for word in hot], "word string")
        known |= {row.word: row.ids for row in dictionary.join(F.broadcast(wanted), "word").select("word", "ids").collect()}
    placed = cut.select(*keys, _placer(known, spark)(F.coalesce("words", F.lit(""))).alias("p")).select(*keys, "p.*")
    placed, _ = write_stage(placed, "placed-words")
    drop_stage(spark, cut_path)
    special = F.array_position(F.array(*[F.lit(t) for t in SPECIAL_TOKENS]), F.col("word"))
    fallback = F.when(special > 0, F.array((special - 1).cast("int"))).otherwise(F.array_repeat(F.lit(UNK), F.length("word")))
    # Not the outer form: rows without other words have nothing to look up.
    others = placed.select(*keys, F.posexplode("others").alias("k", "word"))
    found = others.join(dictionary.select("word", F.col("ids").alias("found")), "word", "left")
    parts = found.groupBy(*[F.col(c).alias(f"_key_{c}") for c in keys]).agg(
        F.array_sort(F.collect_list(F.struct("k", F.coalesce("found", fallback).alias("ids")))).alias("_parts")
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in keys])
    part = lambda x: F.get(F.col("_parts.ids"), -x - 1)
    ids = F.flatten(F.transform("ids", lambda x: F.when(x >= 0, F.array(x)).otherwise(part(x))))
    return placed.join(parts, same, "left").select(*keys, wrap_special(ids).alias("ids"))


def decode(ids: Column, tokens: Sequence[str], skip_special: bool = True) -> Column:
    """Tokens of an id array joined by blanks; ids outside the vocabulary are dropped.

    ``tokens`` (by id) becomes one constant array, so a lookup is an index access.
    """
    table = F.split(F.lit(" ".join(tokens)), " ")
    if skip_special:
        ids = strip_special_ids(ids)
    found = F.transform(ids, lambda x: F.get(table, x))
    return F.array_join(F.filter(found, lambda t: t.isNotNull()), " ")


def encode_batch(
    df: DataFrame,
    vocabulary: Vocabulary,
    text: str,
    batch: Sequence[str] = (),
    max_len: int | None = None,
) -> DataFrame:
    """Encode, pad to the longest row of the batch, and add ``attention_mask``.

    ``batch`` names the columns of a batch; none means that ``df`` is one batch. The
    longest row comes from an aggregate and a join, as a batch may be large; the ids are
    written once, so that the text is encoded once.
    """
    encoded, _ = write_stage(encode(df, vocabulary, {text: "ids"}, max_len), "encoded-batch")
    if batch:
        longest = encoded.groupBy(*batch).agg(F.max(F.size("ids")).alias("_longest"))
        joined = join_on_groups(encoded, small_side(longest, "batch-lengths"), batch)
    else:
        longest = encoded.agg(F.max(F.size("ids"))).first()[0] or 0
        joined = encoded.withColumn("_longest", F.lit(longest))
    return joined.withColumn("ids", pad_ids(F.col("ids"), F.col("_longest"))).drop("_longest").withColumn(
        "attention_mask", attention_mask(F.col("ids"))
    )
