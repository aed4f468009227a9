"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

BPE leaves one token sequence for every piece of text. Its prefixes are the sequences of the
piece's prefixes, so one number per prefix, the last token, holds everything: a token that is
a suffix of the prefix is that last token exactly when the prefix before it ends in a token
after which it can stand. Two tokens can stand side by side when merging the bytes of both
never joins them across the border. A suffix automaton over the vocabulary gives the tokens
that end at each byte, longest first; following the last tokens back gives the ids.
Every piece goes this way, whatever its length; making the merges one by one (``merge_piece``) is the plain check of it.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F, types as T

# Fixed value: how byte-level vocabularies cut text before merging (white space by its Unicode property).
PIECES = regex.compile(
    r" ?+\p{L}++|'(?:s|t|re|ve|m|ll|d)| ?+\p{N}++| ?+[^\p{White_Space}\p{L}\p{N}]++"  # nothing is given back: no tail to match
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
NEVER = 1 << 60
CACHED_PIECES, CACHED_LENGTH, CACHED_PAIRS = 240_000, 48, 200_000
BEGINNING, CACHED_BEGINNINGS = 5, 40_000  # bytes of a piece whose last tokens are kept for pieces that begin alike
SLICE_ROWS = 256  # rows that are encoded at once: bounds a worker's memory, whatever Arrow batches hold


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte: Latin-1 letters stand for themselves, the rest follow from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary; ``ids`` caches pieces already met, packed and within a bound."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], added: dict[str, int]):
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.bytes_of = {i: raw(t) for t, i in vocabulary.items()} | {i: t.encode() for t, i in added.items()}
        self.added = added
        self.merge = {}
        self.halves = {}
        self.merged = []
        for rank, (a, b) in enumerate(merges):
            pair = (vocabulary[a], vocabulary[b])
            self.merge[pair] = rank
            self.merged.append(vocabulary[a + b])
            self.halves.setdefault(vocabulary[a + b], (*pair, rank))
        self.byte_ids = {raw(t)[0]: i for t, i in vocabulary.items() if len(raw(t)) == 1}
        self._left, self._right, self._n_pairs = {}, {}, 0
        self._after: dict[int, dict[int, bool]] = {i: {} for i in self.bytes_of}
        self._begun: dict[bytes, tuple[tuple[int, ...], int]] = {}
        self._reachable: dict[int, bool] = {}
        self._automaton({t for i, t in self.bytes_of.items() if i in self.byte_ids.values() or self.reachable(i)},
                        {raw(t): i for t, i in vocabulary.items()})
        self._left.clear(), self._right.clear()  # of every token; long pieces need few of them
        self._packed = "H" if max(self.bytes_of, default=0) < 1 << 16 else "I"
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.ids = _Pieces(self)

    @classmethod
    def from_json(cls, text: str) -> Codec:
        """From the usual JSON vocabulary file of a byte-level BPE."""
        spec = json.loads(text)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        return cls(spec["model"]["vocab"], merges, {t["content"]: t["id"] for t in spec.get("added_tokens", [])})

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens on one edge of ``token`` from its outermost byte up, each with the rank of the merge that ends it."""
        held = (self._right, self._left)[side]
        if token not in held:
            out, ends = [], NEVER
            at = token
            while True:
                out.append((at, ends))
                if at not in self.halves:
                    break
                left, right, ends = self.halves[at]
                at = left if side else right
            held[token] = out[::-1]
        return held[token]

    def crossing(self, a: int, b: int) -> tuple[int, int] | None:
        """The first pair that merges across the border of ``a`` and ``b``, in order of time."""
        left, right = self._edge(a, 0), self._edge(b, 1)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.merge.get((x, y), NEVER)
            # At equal ranks the merge further left is made first.
            if rank < x_ends and rank <= y_ends and rank < NEVER:
                return x, y
            if x_ends == y_ends == NEVER:
                return None
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def beside(self, a: int, b: int) -> bool:
        found = self._after[b].get(a)
        if found is None:
            if self._n_pairs >= CACHED_PAIRS:
                for held in self._after.values():
                    held.clear()
                self._n_pairs = 0
            self._n_pairs += 1
            found = self._after[b][a] = self.crossing(a, b) is None
        return found

    def reachable(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        todo = [token]
        while todo:
            t = todo[-1]
            if t in self._reachable:
                todo.pop()
            elif t not in self.halves:
                self._reachable[t] = len(self.bytes_of[t]) == 1
            else:
                a, b, _ = self.halves[t]
                missing = [x for x in (a, b) if x not in self._reachable]
                if missing:
                    todo += missing
                else:
                    self._reachable[t] = self._reachable[a] and self._reachable[b] and self.crossing(a, b) == (a, b)
        return self._reachable[token]

    def _automaton(self, tokens: set[bytes], ids: dict[bytes, int]) -> None:
        """States are prefixes of tokens; ``ends`` lists the tokens that end in a state, longest first, each with what is known to stand before it."""
        step: list[dict[int, int]] = [{}]
        own: list[bytes | None] = [None]
        for token in tokens:
            at = 0
            for byte in token:
                to = step[at].get(byte)
                if to is None:
                    to = step[at][byte] = len(step)
                    step.append({})
                    own.append(None)
                at = to
            own[at] = token
        fall = [0] * len(step)
        ends: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()] * len(step)
        queue = list(step[0].values())
        for at in queue:
            mine = ((ids[own[at]], len(own[at]), self._after[ids[own[at]]]),) if own[at] is not None else ()
            ends[at] = mine + ends[fall[at]]
            for byte, to in step[at].items():
                back = fall[at]
                while back and byte not in step[back]:
                    back = fall[back]
                fall[to] = step[back].get(byte, 0)
                queue.append(to)
        self._step, self._fall, self._ends = step, fall, ends
        self._size = {token: length for found in ends for token, length, _ in found}

    def _go(self, state: int, byte: int) -> int:
        """The automaton's next state where no token goes on, remembered among the state's steps."""
        at = state
        while at and byte not in self._step[at]:
            at = self._fall[at]
        to = self._step[state][byte] = self._step[at].get(byte, 0)
        return to

    def merge_piece(self, piece: bytes) -> list[int]:
        """The ids of a piece, by making the first merge of the list (the one further left of equals) until none is left."""
        try:
            ids = [self.byte_ids[byte] for byte in piece]
        except KeyError:
            raise ValueError("the vocabulary does not cover every byte") from None
        rank_of, merged = self.merge.get, self.merged
        ranks = [rank_of(pair, NEVER) for pair in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NEVER:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of((ids[i - 1], ids[i]), NEVER)
            if i < len(ranks):
                ranks[i] = rank_of((ids[i], ids[i + 1]), NEVER)
        return ids

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of a piece: for every prefix its last token, the longest that can stand after the prefix before it."""
        begin = piece[:BEGINNING]
        known = self._begun.get(begin)
        if known is None:
            last = [-1]
            at = self._go_on(begin, last, 0)
            if len(self._begun) >= CACHED_BEGINNINGS:
                self._begun.clear()
            known = self._begun[begin] = tuple(last), at
        last, at = list(known[0]), known[1]
        if len(piece) > BEGINNING:
            self._go_on(piece, last, at)
        out, i, size = [], len(piece), self._size
        while i:
            token = last[i]
            out.append(token)
            i -= size[token]
        out.reverse()
        return tuple(out)

    def _go_on(self, piece: bytes, last: list[int], at: int) -> int:
        """Append the last tokens of the prefixes of ``piece`` that ``last`` does not hold yet; ``at`` is the state there and then."""
        step, ends = self._step, self._ends
        i = len(last)
        for byte in piece[i - 1 :]:
            to = step[at].get(byte)
            at = self._go(at, byte) if to is None else to
            for token, length, after in ends[at]:
                before = last[i - length]
                if before >= 0:
                    fits = after.get(before)
                    if not (self.beside(before, token) if fits is None else fits):
                        continue
                last.append(token)
                break
            else:
                raise ValueError("the vocabulary does not cover every byte")
            i += 1
        return at

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._ids_of(text)
        out: list[int] = []
        for part in self.cut.split(text):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out.extend(self._ids_of(part))
        return out

    def _ids_of(self, text: str) -> list[int]:
        return array(self._packed, b"".join(map(self.ids.__getitem__, PIECES.findall(text)))).tolist()

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Pieces(dict):
    """Packed ids of pieces already met: half of ``CACHED_PIECES`` here, and the half before, from which those met again come back."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.before.get(piece)
        if ids is None:
            ids = array(self.codec._packed, self.codec.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES // 2:
                self.before = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_codecs: dict[int, Codec] = {}


def _codec(key: int, text: str) -> Codec:
    """One codec per worker process, kept from task to task."""
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec.from_json(text)
    return _codecs[key]


def _encoded(codec: Codec, batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in (batch.iloc[at : at + SLICE_ROWS] for batch in batches for at in range(0, len(batch), SLICE_ROWS)):
        ids = [codec.encode(t) for t in texts]
        yield pd.DataFrame({"ids": [np.array(i, np.int32) for i in ids], "decoded": [codec.decode(i) for i in ids]})


_ENCODED = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_texts(docs: DataFrame, vocabulary_path: str, text_col: str = "text") -> DataFrame:
    """Add ``ids`` (token ids of the whole text) and ``decoded`` (the text that those ids give back).

    ``vocabulary_path`` is a JSON vocabulary file read on the driver (bounded by the vocabulary)
    and sent to the tasks. Added tokens inside a text are cut out first. Null and empty texts give
    no ids and an empty ``decoded``; other columns pass through, rows are never merged, and an
    empty table gives an empty result.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        text = file.read()
    key = hash(text)
    shared = docs.sparkSession.sparkContext.broadcast(text)

    @F.pandas_udf(_ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from _encoded(_codec(key, shared.value), batches)

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("ids", "decoded")]
    return docs.withColumn("_encoded", run(F.col(text_col))).select(
        *kept, F.col("_encoded.ids").alias("ids"), F.col("_encoded.decoded").alias("decoded")
    )


def digests(encoded: DataFrame, *columns: str) -> DataFrame:
    """``columns``, ``n_tokens`` and the hashes of the ids and of the decoded text."""
    return encoded.select(
        *columns, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
