"""Learning a joint subword vocabulary by byte-pair merges, and looking at it."""

from __future__ import annotations

from collections.abc import Callable, Container, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from heapq import nsmallest
from math import inf

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import SPECIAL_TOKENS, normalize, pre_tokenize
from ..plans.sizing import broadcast_if_small
from ..plans.stages import drop_stage, new_path, write_stage

# Symbols during training: a character is its code point, merge number k is _MERGED + k.
# Characters get ids by code point and merges get the next ids in turn, so comparing
# symbols is comparing ids.
_MERGED = 0x110000


@dataclass(frozen=True)
class Vocabulary:
    """``vocab(id, token)`` and ``merges(rank, left_id, right_id, new_id)``.

    Both hold at most about ``vocab_size`` rows plus one per distinct character, so
    they may be collected and broadcast whatever the size of the corpus.
    """

    vocab: DataFrame
    merges: DataFrame

    def tokens(self) -> list[str]:
        """Tokens by id."""
        return [row.token for row in self.vocab.orderBy("id").collect()]

    def merge_rules(self) -> list[tuple[int, int, int]]:
        """``(left_id, right_id, new_id)`` by rank."""
        return [
            (row.left_id, row.right_id, row.new_id) for row in self.merges.orderBy("rank").collect()
        ]


def word_counts(lines: DataFrame, line: str = "line") -> DataFrame:
    """Frequency of each pre-token as ``(word, n)``; counts combine before the shuffle."""
    return (
        lines.select(F.explode(pre_tokenize(normalize(F.col(line)))).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


def _characters(words: DataFrame) -> DataFrame:
    return words.select(
        F.explode(F.array_distinct(F.split("word", ""))).alias("token")
    ).distinct()


def alphabet(words: DataFrame) -> DataFrame:
    """Distinct characters by code point as ``(id, token)``, ids after the specials.

    The window has no partition: it sees one row per distinct character, a number
    bounded by Unicode and not by the corpus.
    """
    position = F.row_number().over(Window.orderBy("token"))
    return _characters(words).select(
        (position + F.lit(len(SPECIAL_TOKENS) - 1)).alias("id"), "token"
    )


def character_vocabulary(words: DataFrame) -> Vocabulary:
    """The vocabulary before any merge: the specials and the alphabet (bounded by Unicode)."""
    spark = words.sparkSession
    characters = [(row.id, row.token) for row in alphabet(words).collect()]
    return Vocabulary(
        spark.createDataFrame(list(enumerate(SPECIAL_TOKENS)) + characters, "id int, token string"),
        spark.createDataFrame([], "rank int, left_id int, right_id int, new_id int"),
    )


def _adjacent(symbols: Column) -> Column:
    pairs = F.size(symbols) - 1
    return F.arrays_zip(
        F.slice(symbols, F.lit(1), pairs).alias("left"), F.slice(symbols, F.lit(2), pairs).alias("right")
    )


def pair_counts(words: DataFrame) -> DataFrame:
    """Adjacent characters weighted by word count, as ``(left, right, n)``."""
    return (
        words.select("n", F.inline(_adjacent(F.split("word", ""))).alias("left", "right"))
        .groupBy("left", "right")
        .agg(F.sum("n").alias("n"))
    )


def choose_merges(
    ranked: Sequence[tuple[int, int]], spelling: Mapping[int, str], known: Container[str]
) -> list[tuple[int, int]]:
    """How many of the best pairs may be merged in one pass with the same outcome.

    ``ranked`` holds pairs by falling count, ties by rising symbols. The answer is the
    longest run of leading pairs in which no pair ends with the start, or starts with the
    end, of one before it. Why that is exact: merging (a, b) into a new symbol c changes
    only pairs that end in a or start with b, and creates only (x, c), at most as often
    as (x, a), and (c, y), at most as often as (b, y). The run stops before any (x, a) or
    (b, y), so a created pair never counts more than a pair of the run; and where it
    counts the same it still comes later, because c is greater than every older symbol.
    A pair of equal symbols, or one that spells a known token (whose symbol is then
    reused, so it is not the greatest), goes alone.
    """
    taken: list[tuple[int, int]] = []
    starts: set[int] = set()
    ends: set[int] = set()
    spelled: set[str] = set()
    for left, right in ranked:
        token = spelling[left] + spelling[right]
        alone = left == right or token in known or token in spelled
        if taken and (alone or right in starts or left in ends):
            break
        taken.append((left, right))
        if alone:
            break
        starts.add(left)
        ends.add(right)
        spelled.add(token)
    return taken


@dataclass
class _PairTable:
    """Counts of the pairs that rank up to a fixed place, kept right by differences.

    ``last`` is that place, ``(-n, left, right)``: every pair of the corpus that ranks up to
    it is in ``counts``. A merge only lowers the counts of older pairs, and the pairs that it
    creates come with the differences, so this stays true without counting again.
    """

    counts: dict[tuple[int, int], int]
    last: tuple[float, float, float]

    def ranked(self, n: int) -> list[tuple[int, int]]:
        return [pair for _, *pair in nsmallest(n, ((-c, *p) for p, c in self.counts.items()))]

    def update(self, differences: Mapping[tuple[int, int], int], created: Container[int]) -> None:
        for pair, d in differences.items():
            if pair in self.counts or pair[0] in created or pair[1] in created:
                n = self.counts.get(pair, 0) + d
                self.counts[pair] = n
                if (-n, *pair) > self.last:
                    del self.counts[pair]


class _Words:
    """The distributed table of distinct words, and which of them a merge changes.

    ``base`` holds ``(n, s)`` with the symbols of a word framed by blanks (``' 17  23 '``), so a
    merge is one native ``replace``. Merges since it was written are ``pending`` and folded over
    the words that are read. ``postings`` (written after some scans) lists the words under each
    of their pairs, sorted by pair, so that reading a pair skips all other parts of the files. A
    pair with younger symbols is found under the two older symbols that touch in it.
    """

    def __init__(self, framed: DataFrame):
        self.spark = framed.sparkSession
        # Distinct words in even parts, as every scan runs through all of them.
        self.parts = self.spark.sparkContext.defaultParallelism
        self.base, self.path = write_stage(framed, "bpe-words")
        self._begin()

    def _begin(self) -> None:
        self.pending: list[tuple[int, int, int]] = []
        self.scans, self.postings, self.index_path = 0, None, None
        self.first: dict[int, int] = {}
        self.final: dict[int, int] = {}

    def characters(self) -> list[int]:
        symbols = self.base.select(F.explode(F.array_distinct(_symbols("s"))).alias("s")).distinct()
        return sorted(row.s for row in symbols.collect())

    def top_pairs(self, min_frequency: int, fetch: int) -> _PairTable:
        rows = (
            _open(self.base.select("n", "s"))
            .select("n", F.inline(_adjacent(_symbols("s"))).alias("left", "right"))
            .groupBy("left", "right")
            .agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_frequency)
            .orderBy(F.desc("n"), "left", "right")
            .limit(fetch)
            .collect()
        )
        counts = {(row.left, row.right): row.n for row in rows}
        whole = (-min_frequency, inf, inf)
        return _PairTable(counts, (-rows[-1].n, rows[-1].left, rows[-1].right) if len(rows) == fetch else whole)

    def merge(self, batch: Sequence[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
        """Take up merges; returns the differences they make to the pair counts, of changed words only."""
        signed = lambda w, sign: F.transform(
            _adjacent(_symbols(w)), lambda p: F.struct(p["left"].alias("left"), p["right"].alias("right"), (F.col("n") * sign).alias("d"))
        )
        differ = lambda w, v: F.when(w != v, F.concat(signed(w, -1), signed(v, 1)))
        differences = _let(_merged(F.col("s"), self.pending), lambda w: _let(_merged(w, batch), lambda v: differ(w, v)))
        rows = (
            self._holders(batch)
            .select(F.inline(differences))
            .groupBy("left", "right")
            .agg(F.sum("d").alias("d"))
            .filter("d <> 0")
            .collect()
        )
        self.pending.extend(batch)
        for left, right, new in batch:
            self.first[new], self.final[new] = self.first.get(left, left), self.final.get(right, right)
        return {(row.left, row.right): row.d for row in rows}

    def _holders(self, batch: Sequence[tuple[int, int, int]]) -> DataFrame:
        """``(n, s)`` of words that may change: through the postings of few pairs, by a scan for many."""
        held = sorted({(self.final.get(l, l), self.first.get(r, r)) for l, r, _ in batch})
        keys = [_key(l, r) for l, r in held]
        if self.postings is None or len(keys) > POSTED_PAIRS:
            self.scans += 1
            if self.postings is None and self.scans > INDEX_AFTER:
                self._index()
            else:
                return self.base.filter(reduce(lambda x, y: x | y, [F.contains("s", F.lit(f" {l}  {r} ")) for l, r in held]))
        found = self.postings.filter(F.col("pair").isin(keys))
        if len(keys) > 1:  # a word under several of them counts once, under the smallest
            mine = F.array_intersect(_pair_keys(_symbols("s")), F.array(*[F.lit(k) for k in keys]))
            found = found.filter(F.col("pair") == F.array_min(mine))
        return found.select("n", "s")

    def _index(self) -> None:
        pairs = _open(self.base).select("n", "s", F.explode(F.array_distinct(_pair_keys(_symbols("s")))).alias("pair"))
        self.index_path = new_path(self.spark, "bpe-postings")
        # Placed by pair and word, as a frequent pair would fill one part; small row groups are what a read can skip.
        placed = pairs.repartitionByRange("pair", "s").sortWithinPartitions("pair")
        placed.write.option("compression", "zstd").option("parquet.block.size", 4 << 20).parquet(self.index_path)
        self.postings = self.spark.read.schema(placed.schema).parquet(self.index_path)

    def rewrite(self) -> None:
        """Fold the pending merges into the table; words of one symbol have no pairs and go."""
        old = self.path
        self.base, self.path = write_stage(_open(self.base.select("n", _merged(F.col("s"), self.pending).alias("s"))), "bpe-words")
        self._drop(old, self.index_path)
        self._begin()

    def drop(self) -> None:
        self._drop(self.path, self.index_path)

    def _drop(self, *paths: str | None) -> None:
        for path in paths:
            if path is not None:
                drop_stage(self.spark, path)


#: Up to so many pairs are looked up in the postings; more of them touch so many words that a scan is as good.
POSTED_PAIRS = 8
#: Scans of the words after which the postings are written, since by then they pay.
INDEX_AFTER = 6


def train_bpe(
    words: DataFrame,
    vocab_size: int = 16_000,
    min_frequency: int = 2,
    fetch: int = 20_000,
    rewrite_after: int = 512,
    batch: int = 256,
) -> Vocabulary:
    """Learn merges from ``(word, n)``: best pair first, ties to the smaller ids.

    The table of distinct words stays distributed (see :class:`_Words`); the driver holds the
    ``fetch`` best pairs and keeps their counts right by the differences that each pass of
    merges makes to changed words. A pass takes every merge that :func:`choose_merges`
    allows, up to ``batch``. Pairs are counted anew only when the known ones are used up or
    ``rewrite_after`` merges are pending, which bounds the plan.
    """
    framed = F.concat(
        F.lit(" "), F.array_join(F.transform(F.split("word", ""), lambda c: F.ascii(c)), "  "), F.lit(" ")
    )
    table = _Words(words.repartition(words.sparkSession.sparkContext.defaultParallelism, "word").select("n", framed.alias("s")))
    characters = table.characters()
    spelling = {c: chr(c) for c in characters}
    order = list(characters)
    # No word can spell a special token (brackets and letters never share a word), but
    # the special tokens count towards the size.
    known = dict.fromkeys(SPECIAL_TOKENS, -1) | {t: c for c, t in spelling.items()}
    merges: list[tuple[int, int, int]] = []
    pairs: _PairTable | None = None

    while len(known) < vocab_size:
        if pairs is None or not pairs.counts or len(table.pending) >= rewrite_after:
            if table.pending:
                table.rewrite()
            pairs = table.top_pairs(min_frequency, fetch)
            if not pairs.counts:
                break
        chosen = choose_merges(pairs.ranked(min(batch, vocab_size - len(known))), spelling, known)
        taken, created = [], set()
        for left, right in chosen:
            token = spelling[left] + spelling[right]
            if token not in known:
                known[token] = _MERGED + len(order) - len(characters)
                order.append(known[token])
                spelling[known[token]] = token
                created.add(known[token])
            taken.append((left, right, known[token]))
        merges.extend(taken)
        if len(known) >= vocab_size:
            break
        pairs.update(table.merge(taken), created)
        if len(created) < len(taken):  # a reused symbol: counts of its older pairs may have risen
            pairs = None
    table.drop()
    return _as_vocabulary(words.sparkSession, order, spelling, merges)


def _symbols(s: Column | str) -> Column:
    # A split on one character needs no regular expression.
    return F.split(F.replace(F.trim(s), F.lit("  "), F.lit(" ")), " ").cast("array<int>")


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _key(left: int, right: int) -> int:
    return left << 32 | right


def _pair_keys(symbols: Column) -> Column:
    left = lambda p: F.shiftleft(p["left"].cast("long"), 32)
    return F.transform(_adjacent(symbols), lambda p: left(p).bitwiseOR(p["right"].cast("long")))


def _merged(s: Column, merges: Sequence[tuple[int, int, int]]) -> Column:
    """The framed word after ``merges``, in order.

    The rules are constant arrays that are folded over the word: the expression keeps
    its shape from pass to pass, so its generated code is compiled only once.
    """
    if not merges:
        return s
    old = F.split(F.lit(";".join(f" {left}  {right} " for left, right, _ in merges)), ";")
    new = F.split(F.lit(";".join(f" {new} " for *_, new in merges)), ";")
    rules = F.arrays_zip(old.alias("old"), new.alias("new"))
    return F.aggregate(rules, s, lambda w, rule: F.replace(w, rule["old"], rule["new"]))


def _open(words: DataFrame) -> DataFrame:
    """Without the words that are one symbol and so have no pairs."""
    return words.filter(F.contains("s", F.lit("  ")))


def _as_vocabulary(spark: SparkSession, order, spelling, merges) -> Vocabulary:
    first = len(SPECIAL_TOKENS)
    ids = {symbol: first + i for i, symbol in enumerate(order)}
    vocab = list(enumerate(SPECIAL_TOKENS)) + [(ids[s], spelling[s]) for s in order]
    rules = [(rank, ids[l], ids[r], ids[n]) for rank, (l, r, n) in enumerate(merges)]
    return Vocabulary(
        spark.createDataFrame(vocab, "id int, token string"),
        spark.createDataFrame(rules, "rank int, left_id int, right_id int, new_id int"),
    )


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count("*").alias("vocab_size"))


def special_id_mismatches(vocab: DataFrame) -> DataFrame:
    """Special tokens whose id is not the fixed one, as ``(token, expected_id, actual_id)``."""
    expected = vocab.sparkSession.createDataFrame(
        list(enumerate(SPECIAL_TOKENS)), "expected_id int, token string"
    )
    actual = vocab.filter(F.col("token").isin(*SPECIAL_TOKENS)).select("token", F.col("id").alias("actual_id"))
    return F.broadcast(expected).join(actual, "token", "left").filter(
        ~F.col("expected_id").eqNullSafe(F.col("actual_id"))
    ).select("token", "expected_id", "actual_id")


def check_special_ids(vocab: DataFrame) -> None:
    """Raise RuntimeError naming the first special token with a wrong id."""
    for row in special_id_mismatches(vocab).orderBy("expected_id").take(1):
        raise RuntimeError(
            f"special token {row.token} should have id {row.expected_id}, has {row.actual_id}"
        )


def token_to_id(tokens: DataFrame, vocab: DataFrame, token: str = "token") -> DataFrame:
    """Add ``id``; null where the token is not in the vocabulary."""
    side = vocab.select(F.col("token").alias(token), "id")
    return tokens.join(broadcast_if_small(side), token, "left")


def id_to_token(ids: DataFrame, vocab: DataFrame, id_column: str = "id") -> DataFrame:
    """Add ``token``; rows whose id is not in the vocabulary are dropped."""
    side = vocab.select(F.col("id").alias(id_column), "token")
    return ids.join(broadcast_if_small(side), id_column)
