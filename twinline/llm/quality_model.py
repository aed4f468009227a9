"""Supervised subword embeddings: a quality classifier trained by numpy gradient descent.

A document is the average of learned vectors: one for each of its words and for each
character n-gram of its words, all hashed into one table. A word that follows itself also
counts as a fixed token ``again``, so that stuttering text is seen whatever word it repeats.
A linear layer and softmax give the label. For scoring, a vector's product with the output
layer is folded into one number per table entry, which gives the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from .language_id import held_out
from .words import SPACED, Words, chunks, cut, mix, span_hashes

BUCKETS = 1 << 17
DIMENSIONS = 8
NGRAMS = (1, 2, 3)
AGAIN = 0  # table entry of the token "again"; hashed features start behind it


def _word_features(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of the given words and of their character n-grams, with the position of the word in ``which``."""
    starts, ends = words.starts[which], words.ends[which]
    out, owner = [mix(words.hashes[which] + np.uint64(11))], [np.arange(len(which))]
    for n in NGRAMS:
        each = np.maximum(ends - starts - n + 1, 0)
        of = np.repeat(np.arange(len(which)), each)
        at = starts[of] + np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
        out.append(mix(span_hashes(words.codes, at, at + n) + np.uint64(n)))
        owner.append(of)
    entries = np.concatenate(out) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return entries.astype(np.int64), np.concatenate(owner)


def _again(words: Words) -> np.ndarray:
    """Per text, the words that equal the word before them."""
    same = (words.hashes[1:] == words.hashes[:-1]) & (words.owner[1:] == words.owner[:-1])
    return np.bincount(words.owner[1:][same], minlength=words.n_texts)


def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct table entries and their shares, per text."""
    out = []
    for text in texts:
        words = cut([text], SPACED)
        entries, _ = _word_features(words, np.arange(len(words.hashes)))
        entries = np.concatenate((entries, np.full(_again(words)[0], AGAIN)))
        kinds, counts = np.unique(entries, return_counts=True)
        out.append((kinds, (counts / max(len(entries), 1)).astype(np.float32)))
    return out


@dataclass
class Model:
    vectors: np.ndarray
    output: np.ndarray
    bias: np.ndarray

    def folded(self) -> tuple[np.ndarray, float]:
        """Margin of label 1 over label 0 per table entry, and of the bias."""
        return (self.vectors @ (self.output[1] - self.output[0])).astype(np.float64), float(self.bias[1] - self.bias[0])


def train(texts: list[str], labels: list[int], epochs: int = 10, rate: float = 4.0, seed: int = 7) -> Model:
    """Plain stochastic gradient descent on the softmax loss, one document at a time, rate falling to zero."""
    rng = np.random.default_rng(seed)
    model = Model(
        rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32),
        np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32),
    )
    data = features(texts)
    total, done = max(epochs * len(data), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(len(data)):
            entries, shares = data[i]
            now = rate * (1 - done / total)
            done += 1
            x = shares @ model.vectors[entries]
            logits = model.output @ x + model.bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1.0  # gradient of the loss by the logits
            back = p @ model.output
            model.output -= now * 0.1 * np.outer(p, x).astype(np.float32)
            model.bias -= now * 0.01 * p
            model.vectors[entries] -= now * np.outer(shares, back).astype(np.float32)
    return model


def score(folded: np.ndarray, bias: float, texts: list[str | None]) -> np.ndarray:
    """Probability of label 1 of every text; a text without words gets what the bias says."""
    out = np.zeros(len(texts))
    for first, chunk in chunks(texts):
        words = cut(chunk, SPACED)
        kinds, at, back = np.unique(words.hashes, return_index=True, return_inverse=True)
        entries, of = _word_features(words, at)
        sums = np.bincount(of, weights=folded[entries], minlength=len(kinds))
        size = np.bincount(of, minlength=len(kinds)).astype(np.float64)
        again = _again(words)
        margin = np.bincount(words.owner, weights=sums[back], minlength=len(chunk)) + again * folded[AGAIN]
        total = np.bincount(words.owner, weights=size[back], minlength=len(chunk)) + again
        out[first : first + len(chunk)] = 1 / (1 + np.exp(-np.clip(margin / np.maximum(total, 1) + bias, -500, 500)))
    return out


_MODEL = T.StructType([T.StructField("margins", T.BinaryType()), T.StructField("bias", T.DoubleType())])


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    margins, bias = train(rows["text"].fillna("").tolist(), rows["label"].astype(int).tolist()).folded()
    yield pd.DataFrame({"margins": [margins.astype(np.float32).tobytes()], "bias": [bias]})


def fit(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> tuple[np.ndarray, float]:
    """Train in one task on the rows of :func:`labelled_rows`."""
    picked = labelled_rows(docs, labels, max_rows, id_col, text_col, label_col)
    row = picked.repartition(1).sortWithinPartitions("_i", "text").mapInPandas(_fit, _MODEL).first()
    if row is None:
        return np.zeros(BUCKETS), 0.0
    return np.frombuffer(row.margins, np.float32).astype(np.float64), row.bias


def labelled_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``_i, text, label``: distinct texts of about ``max_rows`` labelled ids, picked by a hash of the id.

    At most twice ``max_rows`` rows, however many texts an id repeats; of more, those of the smallest text hash.
    """
    known = labels.filter(~held_out(id_col) & F.col(label_col).isin(0, 1)).select(
        F.col(id_col).alias("_i"), F.col(label_col).cast("int").alias("label")
    ).dropDuplicates(["_i"])
    share = F.pmod(F.xxhash64("_i"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = known.filter(share < float(max_rows) / max(known.count(), 1))
    # At most about max_rows ids, so the side of this broadcast is bounded by a parameter.
    rows = docs.select(F.col(id_col).alias("_i"), F.col(text_col).alias("text")).join(F.broadcast(picked), "_i")
    return rows.select("_i", "text", "label").distinct().orderBy(F.xxhash64("text"), "_i", "label").limit(2 * max_rows)


def score_quality(
    docs: DataFrame, labels: DataFrame, max_rows: int = 3000,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """Add ``score``, the probability of label 1, to every row of ``docs``.

    Learns from labelled rows that are not held out, about ``max_rows`` of them. Null and empty
    texts get the score of the bias; null labels, and labels other than 0 and 1, are not learned from.
    Without any usable label every score is 0.5. Repeated rows are all answered, repeated ids in
    ``labels`` count once, other columns pass through, an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_rows, id_col, text_col, label_col))

    @F.pandas_udf(T.DoubleType())
    def answer(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        folded, bias = shared.value
        for texts in batches:
            yield pd.Series(score(folded, bias, texts.tolist()))

    return docs.withColumn("score", answer(F.col(text_col)))
