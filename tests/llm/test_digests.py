"""SimHash components, hard negatives and Merkle manifests against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from twinline.llm import hard_negatives, merkle, simhash_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, component_id string, root string, table int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "y", 1) for r in rows], DOCS)


def rows_of(texts, langs=("en",)):
    return [(i, t, langs[i % len(langs)], "s", None if t is None else len(t)) for i, t in enumerate(texts)]


# ---- SimHash


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    runs = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    votes = [0] * 64
    for r in runs:
        h = xxhash.xxh64_intdigest(r.encode(), seed=42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(runs))


def brute_components(rows):
    prints = [brute_fingerprint(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted(((r[0], f"{prints[i]:016x}", least.get(root(i))) for i, r in enumerate(rows)), key=str)


def near_copies(rng, n):
    base = ["w%d" % rng.randrange(3000) for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(400)] = "z%d" % rng.randrange(10**6)
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("dense", [1024, 2])
def test_components_against_all_pairs(spark, dense):
    rng = random.Random(3)
    texts = near_copies(rng, 60) + near_copies(rng, 60) + [" ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(1, 9))) for _ in range(80)]
    texts += [None, "", " \t\n", "One", "one", "ONE  two", "one\x0btwo", "İ ß É x y", "a b c " * 30_000, "a b c " * 30_000]
    rows = rows_of(texts) + [(None, "lone null id here", "en", "s", 1), (None, "one", "en", "s", 1), (3, texts[3], "en", "s", 1), (3, texts[70], "en", "s", 1)]
    got = simhash_dedup.simhash_components(frame(spark, rows), dense=dense)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    expected = brute_components(rows)
    assert sorted(map(tuple, got.collect()), key=str) == expected
    assert len({c for _, _, c in expected}) < len(rows) - 30  # there is something to link


def test_links_of_random_prints_are_exact_and_whole(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(6):
            q = p
            for b in rng.sample(range(64), rng.randrange(1, 5)):
                q ^= 1 << b
            prints.add(q)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    wanted = {tuple(sorted((a, b))) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3}
    unsigned = lambda x: x % (1 << 64)
    got = {tuple(sorted((unsigned(r.a), unsigned(r.b)))) for r in simhash_dedup.fingerprint_links(table).collect()}
    assert got == wanted
    # By flips: no pair that is too far apart, and the same closure.
    star = {tuple(sorted((unsigned(r.a), unsigned(r.b)))) for r in simhash_dedup.fingerprint_links(table, dense=1).collect()}
    assert star <= wanted
    parts = lambda links: sorted(map(sorted, closure(prints, links)))
    assert parts(star) == parts(wanted)


def closure(nodes, links):
    groups = {n: {n} for n in nodes}
    for a, b in links:
        if groups[a] is not groups[b]:
            groups[a] |= groups[b]
            for x in groups[b]:
                groups[x] = groups[a]
    return {id(g): g for g in groups.values()}.values()


def test_components_of_an_empty_table(spark):
    assert simhash_dedup.simhash_components(frame(spark, [])).collect() == []


# ---- hard negatives


VECTORS = "vec_id long, label int, embedding array<float>, row long, score double, slot int"


def brute_negatives(rows, every=50, k_pos=5, k_neg=3):
    usable = [
        (i, v, lab, [math.floor(256 * float(np.float32(x))) for x in e])
        for i, (v, lab, e) in enumerate(rows)
        if lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)
    ]
    order = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for i, v, lab, e in usable:
        if v is None or v % every:
            continue
        near = [(w, sum(a * b for a, b in zip(e, f)), j, m) for j, w, m, f in usable if len(f) == len(e)]
        for p in sorted((x for x in near if x[3] == lab and x[2] != i), key=order)[:k_pos]:
            fits = sorted((x for x in near if x[3] != lab and 50 * p[1] <= 100 * x[1] <= 95 * p[1]), key=order)[:k_neg]
            out += [(v, p[0], r + 1, x[0], p[1], x[1]) for r, x in enumerate(fits)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, 3) for r in rows], VECTORS)


def cloud(rng, n, dim, spread=0.6):
    centres = rng.standard_normal((4, dim))
    rows = []
    for i in range(n):
        v = centres[i % 4] + spread * rng.standard_normal(dim)
        rows.append((i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in v / np.linalg.norm(v)]))
    return rows


@pytest.mark.parametrize("dim, cells", [(8, 1 << 21), (64, 1 << 8), (70, 1 << 21)])
def test_negatives_against_all_pairs(spark, dim, cells):
    rows = cloud(np.random.default_rng(dim), 400, dim)
    got = hard_negatives.hard_negatives(vectors(spark, rows), "id % 50 = 0", chunk_cells=cells)
    expected = brute_negatives(rows)
    assert sorted(map(tuple, got.collect()), key=str) == expected and len(expected) > 30


def test_negatives_with_nulls_ties_repeats_and_odd_lengths(spark):
    rng = np.random.default_rng(1)
    rows = cloud(rng, 160, 6)
    rows += [(50, 1, rows[50][2]), (50, 1, rows[50][2]), (None, 1, rows[3][2]), (None, 2, rows[4][2]), (400, None, rows[5][2]), (450, 1, None)]
    rows += [(500, 1, [0.5, None, 0.5]), (550, 1, [0.5, float("nan"), 0.5]), (600, 1, [0.5, float("inf"), 0.5])]
    rows += [(650, 1, []), (651, 1, []), (652, 2, []), (700, 0, [0.0] * 6), (750, 1, [1.0, 2.0]), (751, 1, [1.0, 1.0]), (752, 2, [0.5, 0.5]), (-50, 2, rows[9][2])]
    rows += [(800 + i, i % 3, rows[7][2]) for i in range(40)]  # many equal vectors
    got = hard_negatives.hard_negatives(vectors(spark, rows), "id % 50 = 0")
    assert sorted(map(tuple, got.collect()), key=str) == brute_negatives(rows)
    assert hard_negatives.hard_negatives(vectors(spark, []), "id % 50 = 0").collect() == []
    assert hard_negatives.hard_negatives(vectors(spark, rows), "id > 5000").collect() == []


def test_very_large_components_do_not_overflow(spark):
    rows = [(0, 1, [6e6, 1.0]), (1, 1, [5e6, 1.0]), (2, 2, [4e6, 1.0]), (3, 2, [-5e6, 1.0])]
    got = hard_negatives.hard_negatives(vectors(spark, rows), "id % 50 = 0").collect()
    assert [tuple(r) for r in got] == brute_negatives(rows) != []
    # Beyond 64 bits scores are cut: both positive and negative stand at the end of the range.
    huge = [(i, lab, [1e9 * x for x in v]) for i, lab, v in rows]
    assert hard_negatives.hard_negatives(vectors(spark, huge), "id % 50 = 0").collect() == []


def test_intervals_hold_every_score_and_some_pairs_are_ruled_out():
    rng = np.random.default_rng(2)
    for dim in (5, 64, 130):
        ints = np.floor(256 * rng.standard_normal((300, dim))).astype(np.int64)
        codes, norm, align = hard_negatives.encode(ints)
        q = hard_negatives.Queries.of(np.arange(40), np.arange(40), np.zeros(40, object), ints[:40])
        lower, upper = hard_negatives.intervals(q, codes, norm, align)
        scores = hard_negatives.exact_scores(ints[:40], ints)
        assert (lower <= scores).all() and (scores <= upper).all()
        # A row and itself: the interval lies above those of most other rows.
        own = scores[np.arange(40), np.arange(40)]
        assert (upper < own[:, None]).mean() > 0.5


# ---- Merkle manifest


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, text):
    frame_ = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    i, _, lang, source, n = row
    return sha("".join(map(frame_, (i, source, lang, n, text))))


def brute_manifest(rows, fanout=8):
    plain = [leaf_of(r, r[1]) for r in rows]
    changed = []
    for r in rows:
        hit = r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
        changed.append(leaf_of(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]) if hit else r[1]))

    def tree(hashes):
        paths, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
        while len(level) > 1:
            for leaf, i in enumerate(at):
                run = i // fanout * fanout
                paths[leaf].append(("".join(level[run:i]), "".join(level[i + 1 : run + fanout])))
            level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
            at = [i // fanout for i in at]
        return level[0], paths

    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(r[2], []).append(k)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, leaf_paths = {}, {}
    for g in order:
        ks = sorted(groups[g], key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, plain[k]))
        subroots[g], paths = tree([plain[k] for k in ks])
        leaf_paths |= dict(zip(ks, paths))
    if not order:
        return []
    root, upper = tree([subroots[g] for g in order])
    out = []
    for k, r in enumerate(rows):
        path = leaf_paths[k] + upper[order.index(r[2])]
        h = changed[k]
        for before, after in path:
            h = sha(before + h + after)
        out.append((r[0], plain[k], subroots[r[2]], root, sha("".join(b + a for b, a in path)), h, h == root))
    return sorted(out, key=str)


def manifest(spark, rows, **named):
    tampered = merkle.lowered_for_a_third(F.col("text"), F.col("doc_id"))
    return merkle.manifest(frame(spark, rows), tampered, **named)


@pytest.mark.parametrize("n, langs", [(1, ("en",)), (8, ("en",)), (9, ("en", None)), (600, ("en", "de", "en", "en", None, "é", "Z")), (90, tuple(map(str, range(70))))])
def test_manifest_against_plain_trees(spark, n, langs):
    rng = random.Random(n)
    rows = rows_of([rng.choice(["", "Abc Ünï", "lower only", "X" * 5000]) + str(i) if i % 9 else None for i in range(n)] if n > 9 else ["A%d" % i for i in range(n)], langs)
    rng.shuffle(rows)
    got = sorted(map(tuple, manifest(spark, rows).collect()), key=str)
    assert got == brute_manifest(rows)
    assert {r[6] for r in got} == ({True, False} if n > 9 else {r[6] for r in got})


def test_manifest_with_null_and_repeated_ids_and_other_fanouts(spark):
    rows = rows_of(["A b", "A b", None, "", "q"] * 5)
    rows += [(None, "Null id", None, None, None), (None, "Null id", None, None, None), (4, "Another four", "en", "s", None), rows[4], rows[4]]
    assert sorted(map(tuple, manifest(spark, rows).collect()), key=str) == brute_manifest(rows)
    assert sorted(map(tuple, manifest(spark, rows, fanout=2).collect()), key=str) == brute_manifest(rows, 2)
    assert manifest(spark, []).collect() == []
