"""Language identification with bit-sliced Bloom filters of character n-grams.

One table of slots holds a bit for every language; a slot is set for a language when one
of its n-grams hashes there. Looking up an n-gram combines its slots with AND and gives at
once all languages that contain it. A language's popcount over the n-grams of a text,
corrected for the false positives that its fill rate predicts, decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .words import Words, chunks, cut, mix, span_hashes

UNDETERMINED = "und"
NGRAMS = (2, 3, 4)
SLOTS = 1 << 20
HASHES = 3


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from; a null id counts as learnable."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def _letters() -> np.ndarray:
    table = np.zeros(129, bool)
    table[[c for c in range(128) if chr(c).isalpha()]] = True
    table[128] = True
    return table


LETTERS = _letters()


def _is_letter(codes: np.ndarray) -> np.ndarray:
    kinds, back = np.unique(codes, return_inverse=True)
    return np.fromiter((chr(c).isalpha() for c in kinds), bool, len(kinds))[back]


def cut_letters(texts: list[str]) -> Words:
    """Words of letters only; ASCII is decided by table, anything else by its Unicode category."""
    words = cut(texts, LETTERS)
    if words.codes.size and words.codes.max() >= 128:
        bad = np.flatnonzero(words.codes >= 128)
        bad = bad[~_is_letter(words.codes[bad])]
        if bad.size:  # rare: other characters beyond ASCII cut words as well
            chars = "".join(set(map(chr, np.unique(words.codes[bad]))))
            return cut([t.lower().translate(dict.fromkeys(map(ord, chars), " ")) for t in texts], LETTERS)
    return words


def word_ngrams(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of the given words, and the position of their word in ``which``.

    A word is taken with its edges, so a bigram at a word's start differs from one inside.
    """
    out, owner = [], []
    starts, ends = words.starts[which], words.ends[which]
    for n in NGRAMS:
        each = np.maximum(ends - starts - n + 1, 0)
        of = np.repeat(np.arange(len(which)), each)
        at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        edge = (at == starts[of]) * 1 + (at + n == ends[of]) * 2
        out.append(mix(span_hashes(words.codes, at, at + n) + (np.uint64(n) * np.uint64(8) + edge.astype(np.uint64))))
        owner.append(of)
    whole = np.arange(len(which))
    out.append(mix(words.hashes[which] + np.uint64(7)))
    owner.append(whole)
    return np.concatenate(out), np.concatenate(owner)


@dataclass
class Filters:
    languages: list[str]
    table: np.ndarray  # slots x words of 64 languages
    false_rate: np.ndarray

    def slots(self, grams: np.ndarray) -> Iterator[np.ndarray]:
        for i in range(HASHES):
            yield (mix(grams + np.uint64(i << 56 | i)) & np.uint64(SLOTS - 1)).astype(np.int64)

    def containing(self, grams: np.ndarray) -> np.ndarray:
        """One row of 64-bit masks per n-gram: the languages that contain it."""
        mask = None
        for at in self.slots(grams):
            mask = self.table[at] if mask is None else mask & self.table[at]
        return mask


def learn(texts: list[str], languages: list[str], min_texts: int = 2) -> Filters:
    """Filters of the n-grams that at least ``min_texts`` texts of a language contain (all, if it has few texts)."""
    names = sorted(set(languages))
    table = np.zeros((SLOTS, (len(names) + 63) // 64 or 1), np.uint64)
    out = Filters(names, table, np.zeros(len(names)))
    for li, name in enumerate(names):
        own = [t for t, g in zip(texts, languages) if g == name]
        seen = []
        for _, chunk in chunks(own):
            words = cut_letters(chunk)
            kinds, first, back = np.unique(words.hashes, return_index=True, return_inverse=True)
            grams, of = word_ngrams(words, first)
            pair = np.unique(np.stack([words.owner.astype(np.int64), back.astype(np.int64)]), axis=1)
            # every text's n-grams once: expand the words of a text to their n-grams
            order = np.argsort(of, kind="stable")
            size = np.bincount(of, minlength=len(kinds))
            begin = np.cumsum(size) - size
            each = size[pair[1]]
            at = np.repeat(begin[pair[1]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            doc = np.repeat(pair[0], each)
            gram = grams[order][at]
            keep = np.lexsort((doc, gram))
            gram, doc = gram[keep], doc[keep]
            new = np.ones(len(gram), bool)
            new[1:] = (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])
            values, count = np.unique(gram[new], return_counts=True)
            seen.append((values, count))
        if not seen:
            continue
        values = np.concatenate([v for v, _ in seen])
        counts = np.concatenate([c for _, c in seen])
        kinds, back = np.unique(values, return_inverse=True)
        totals = np.bincount(back, weights=counts, minlength=len(kinds))
        kept = kinds[totals >= min(min_texts, max(1, len(own) // 2))]
        bit = np.uint64(1) << np.uint64(li % 64)
        for at in out.slots(kept):
            table[np.unique(at), li // 64] |= bit
        fill = ((table[:, li // 64] & bit) != 0).mean()
        out.false_rate[li] = fill**HASHES
    return out


def predict(filters: Filters, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. The score is the share of its n-grams that the language contains.

    Null, empty and letterless texts are ``und`` with score 0; ties go to the first language by name.
    """
    names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    for first, chunk in chunks(texts):
        words = cut_letters(chunk)
        if not len(words.hashes) or not filters.languages:
            continue
        kinds, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        grams, of = word_ngrams(words, at)
        masks = filters.containing(grams)
        size = np.bincount(of, minlength=len(kinds)).astype(np.float64)
        total = np.bincount(words.owner, weights=size[back], minlength=len(chunk))
        found = np.empty((len(chunk), len(filters.languages)))
        for li, rate in enumerate(filters.false_rate):
            held = (masks[:, li // 64] >> np.uint64(li % 64)) & np.uint64(1)
            per_word = np.bincount(of[held.astype(bool)], minlength=len(kinds))
            hits = np.bincount(words.owner, weights=per_word[back], minlength=len(chunk))
            found[:, li] = np.maximum(hits - rate * total, 0) / max(1 - rate, 1e-9)
        best = found.argmax(axis=1)
        for i in np.flatnonzero(total > 0):
            names[first + i] = filters.languages[best[i]]
            scores[first + i] = min(1.0, found[i, best[i]] / total[i])
    return names, scores


def learnable(docs: DataFrame, per_language: int, kinds: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """About ``per_language`` distinct texts of each language, picked by a hash of id and text; held-out rows never.

    The picked share follows from the language's count, so no window gathers a language in one task.
    At most twice as many rows as asked in all, whatever ids and texts repeat or are null.
    """
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    share = F.pmod(F.xxhash64("_i", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = rows.join(F.broadcast(counts), "lang").filter(share < F.lit(float(per_language)) / F.col("_n"))
    wanted = 2 * per_language * max(kinds, 1)
    return picked.select("text", "lang").distinct().orderBy(F.xxhash64("text"), "lang").limit(wanted)


def identify_languages(
    docs: DataFrame,
    per_language: int = 400,
    max_texts: int = 4000,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> DataFrame:
    """Add ``lang_pred`` and ``score`` to every row, learning from the table's own labelled rows.

    ``per_language`` and ``max_texts`` bound what is learned from (texts picked by a hash of
    id and text, the same share of each language). Null and
    letterless texts give ``und`` and 0. Repeated rows are all answered; other columns pass
    through. An empty table, or one without labels, gives ``und`` everywhere.
    """
    kinds = docs.select(F.col(lang_col).alias("g")).filter("g IS NOT NULL").distinct().limit(max_texts + 1).count()
    if kinds > max_texts:
        raise ValueError(f"more than {max_texts} languages; pass a larger max_texts")
    per_language = min(per_language, max_texts // max(kinds, 1))
    sample = learnable(docs, per_language, kinds, id_col, text_col, lang_col).collect()  # at most 2 * max_texts rows
    sample.sort(key=lambda r: (r.lang, r.text))
    filters = learn([r.text for r in sample], [r.lang for r in sample])
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(shared.value, texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    named = docs.withColumn("_language", answer(F.col(text_col)))
    return named.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score")],
                        F.col("_language.lang_pred").alias("lang_pred"), F.col("_language.score").alias("score"))
