"""The batched choice of merges gives the same result as one merge at a time."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from twinline.operators.vocab import choose_merges

FIRST_MERGED = 0x110000


def _apply(word, left, right, new):
    out, i = [], 0
    while i < len(word):
        if i + 1 < len(word) and word[i] == left and word[i + 1] == right:
            out.append(new)
            i += 2
        else:
            out.append(word[i])
            i += 1
    return out


def _learn(corpus: Counter, size: int, batched: bool, min_frequency: int = 2):
    words = [([ord(c) for c in w], n) for w, n in corpus.items()]
    letters = sorted({c for w, _ in words for c in w})
    spelling = {c: chr(c) for c in letters}
    known = {t: c for c, t in spelling.items()}
    merges, made, rounds = [], 0, 0
    while len(known) < size:
        counts = Counter()
        for w, n in words:
            for pair in zip(w, w[1:]):
                counts[pair] += n
        ranked = sorted(
            (p for p, n in counts.items() if n >= min_frequency), key=lambda p: (-counts[p], p)
        )
        if not ranked:
            break
        rounds += 1
        batch = choose_merges(ranked, spelling, known) if batched else ranked[:1]
        for left, right in batch[: size - len(known)]:
            token = spelling[left] + spelling[right]
            if token not in known:
                known[token] = FIRST_MERGED + made
                spelling[known[token]] = token
                made += 1
            merges.append((spelling[left], spelling[right]))
            words = [(_apply(w, left, right, known[token]), n) for w, n in words]
    return merges, list(known), rounds


def _random_corpus(seed: int) -> tuple[Counter, int]:
    rng = random.Random(seed)
    letters = "abcdef"[: rng.randint(2, 6)]
    corpus = Counter()
    for _ in range(rng.randint(1, 25)):
        word = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
        corpus[word] += rng.choice([1, 1, 1, 2, 2, 3, 5])
    return corpus, rng.randint(4, 60)


@pytest.mark.parametrize("block", range(10))
def test_batched_equals_one_at_a_time(block):
    for seed in range(block * 200, block * 200 + 200):
        corpus, size = _random_corpus(seed)
        assert _learn(corpus, size, True)[:2] == _learn(corpus, size, False)[:2], seed


def test_batched_equals_the_tokenizers_package():
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, pre_tokenizers, trainers

    for seed in range(300):
        corpus, size = _random_corpus(seed)
        merges, known, _ = _learn(corpus, size, True)
        tok = tokenizers.Tokenizer(models.BPE(unk_token="[UNK]"))
        tok.pre_tokenizer = pre_tokenizers.Whitespace()
        trainer = trainers.BpeTrainer(
            vocab_size=size + 4, min_frequency=2, show_progress=False,
            special_tokens=["[PAD]", "[UNK]", "[SOS]", "[EOS]"],
        )
        tok.train_from_iterator([" ".join([w] * n) for w, n in corpus.items()], trainer=trainer)
        vocab = tok.get_vocab()
        assert sorted(vocab, key=vocab.get)[4:] == known, seed


def test_batches_are_worth_it():
    rng = random.Random(5)
    letters = "etaoinshrdlucmfwypvbgkjqxz"
    corpus = Counter()
    for _ in range(4000):
        corpus["".join(rng.choice(letters[: rng.randint(3, 26)]) for _ in range(rng.randint(2, 10)))] += 1
    merges, _, rounds = _learn(corpus, 400, True)
    assert len(merges) > 2 * rounds
