"""The corpus pipeline against plain Python, on documents with planted copies, leaks and repeated lines."""

from __future__ import annotations

import hashlib
import random

import pytest

import corpus_pipeline
from tests.llm.test_pairs import brute_classes, brute_lines, words
from tests.llm.test_texts import brute_windows

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lines(base, width):
    return "\n".join(" ".join(base[i : i + width]) for i in range(0, len(base), width))


def planted():
    """Documents, benchmark items, and the ids that have no language we know."""
    rng = random.Random(77)
    pools = [("en", words(rng, 250)), ("de", ["".join(chr(ord(c) + 13) for c in w) for w in words(rng, 250)])]
    docs, unknown = [], set()
    add = lambda text, lang: docs.append((len(docs), text, lang))
    items = [(i, " ".join(rng.choices(pools[i % 2][1], k=16))) for i in range(4)]
    repeated = [" ".join(rng.sample(p, 14)) for _, p in pools]
    for n in range(60):
        k = n % 2
        lang, pool = pools[k]
        base = rng.choices(pool, k=90)
        add(lines(base, 30), lang)
        if n % 5 == 0:
            add(lines(base, 30), lang)  # a copy: line dedup empties it
        if n % 6 == 0:
            add(lines(base, 17), lang)  # a copy broken at other words
        if n % 7 == 0:
            add(lines(base, 30) + "\n" + repeated[k], lang)
        if n % 8 == 0:
            w = rng.choices(pool, k=60)
            w[30:30] = items[(k + 2 * (n % 3)) % 4][1].split()[2:14]
            add(lines(w, 80), lang)
        if n % 9 == 0:
            add(lines(rng.choices(pool, k=40), 20) + "\n" + repeated[k], lang)
        if n % 12 == 0:
            unknown |= {len(docs), len(docs) + 1, len(docs) + 2}
            add(" ".join("".join(rng.choices("абвгдежзик", k=6)) for _ in range(30)), None)
            add("... 12 !", lang)
            add(None, lang)
    return docs, items, unknown


def test_every_stage_equals_plain_python(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows, items, unknown = planted()
    lang = {i: g for i, _, g in rows}
    frame = lambda kept: spark.createDataFrame([(i, t, lang[i], "s", len(t or "")) for i, t in kept], DOCS)
    start = [(i, t) for i, t, _ in rows]
    frame(start).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    known = [(i, t) for i, t in start if i not in unknown]
    cleaned = [(i, t) for i, t, _ in brute_lines(known)]
    classes, wordless = brute_classes(cleaned), {}
    for i, t in sorted(cleaned):
        if not t.split():
            wordless.setdefault(t, i)
    one = [(i, t) for i, t in cleaned if classes[i] == i and wordless.get(t, i) == i]
    leaking = {i for i, n_hit, _ in brute_windows(one, items) if n_hit}
    clean = [(i, t) for i, t in one if i not in leaking]
    # Every stage has something to take away and much to keep.
    assert len(start) > len(known) > len(one) > len(clean) > 60 and known != cleaned and sum(t == "" for _, t in cleaned) > 5

    stages = [start, known, cleaned, one, clean]
    for (name, stage), before, after in zip(corpus_pipeline.STAGES, stages, stages[1:]):
        got = stage(spark, frame(before), str(tmp_path)).collect()
        assert sorted((r.doc_id, r.text, r.n_chars, r.lang) for r in got) == sorted((i, t, len(t), lang[i]) for i, t in after), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == sorted((i, hashlib.sha256(t.encode()).hexdigest()) for i, t in clean)
