"""Substring, line and near-duplicate operators against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from twinline.llm import components, line_dedup, minhash_dedup, substring_dedup
from twinline.llm.words import chunks, cut

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _t string, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra", 1) for i, t in rows], DOCS)


def words(rng, n, size=6):
    return ["".join(rng.choice("abcdefghijklm") for _ in range(size)) for _ in range(n)]


def edited(rng, base, n):
    out = list(base)
    for _ in range(n):
        out[rng.randrange(len(out))] = "zz" + str(rng.randrange(10**6))
    return out


# ---- near duplicates


def brute_classes(rows, threshold=0.8):
    def grams(text):
        w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()
        if len(w) < 5:
            return Counter([tuple(w)] if w else [])
        return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    sets = [grams(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = sum((sets[i] & sets[j]).values())
            if both and both >= threshold * sum((sets[i] | sets[j]).values()):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    return {rows[i][0]: min(x for x in groups[root(i)] if x is not None) for i in range(len(rows)) if rows[i][0] is not None}


def near_rows():
    rng = random.Random(4)
    rows = []
    for _ in range(12):
        base = words(rng, rng.choice([6, 40, 200]))
        for _ in range(rng.randint(1, 6)):
            rows.append(" ".join(edited(rng, base, rng.choice([0, 0, 1, 2, 6]))))
    hub = words(rng, 120)
    rows += [" ".join(edited(rng, hub, 2)) for _ in range(60)]  # a large family of near copies
    rows += [" ".join(hub)] * 30
    rows += ["", None, "...", "one", "one", "One!", "a b c d", "a b c d e", "Oure " * 300, "Oure " * 290, "x " * 5000]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_duplicates_are_the_brute_force_classes(spark):
    rows = near_rows()
    got = {r.doc_id: r for r in minhash_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    expected = brute_classes(rows)
    for i, text in rows:
        lone = not any(c.isalnum() for c in text or "")
        assert got[i].class_id == (i if lone else expected[i])
        assert got[i].kept == (got[i].class_id == i)


def test_a_large_family_at_the_threshold_loses_no_link(spark):
    rng = random.Random(17)
    rows = []
    for start in (0, 200):
        base = words(rng, 100)
        rows += [(start + i, " ".join(edited(rng, base, rng.randint(1, 4)))) for i in range(90)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    expected = brute_classes(rows)
    assert len(set(expected.values())) > 10  # neither one class nor only singles
    assert got == {i: expected[i] for i, _ in rows}


@pytest.mark.parametrize("few", [-1, 4])
def test_few_pairs_left_are_compared_without_further_leaders(spark, monkeypatch, few):
    names, plain = [], minhash_dedup.write_stage
    monkeypatch.setattr(minhash_dedup, "write_stage", lambda df, name: names.append(name) or plain(df, name))
    monkeypatch.setattr(minhash_dedup, "FEW", few)
    rng = random.Random(29)
    bases = [words(rng, 100) for _ in range(16)]
    rows = [(i, " ".join(edited(rng, bases[i // 4], rng.randint(1, 4)))) for i in range(64)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert names.count("candidates") <= 2 if few > 0 else names.count("candidates") > 2


def test_components_are_settled_once_and_turns_are_few(spark, monkeypatch):
    names, settled, plain, stars = [], [], minhash_dedup.write_stage, minhash_dedup.stars
    monkeypatch.setattr(minhash_dedup, "write_stage", lambda df, name: names.append(name) or plain(df, name))
    monkeypatch.setattr(minhash_dedup, "stars", lambda edges: settled.append(1) or stars(edges))
    monkeypatch.setattr(minhash_dedup, "FEW", -1)  # no turn is left out
    rng = random.Random(31)
    base = words(rng, 100)
    rows = [(i, " ".join(edited(rng, base, rng.randint(2, 5)))) for i in range(120)]
    got = {r.doc_id: r.class_id for r in minhash_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)
    assert len(settled) == 1 and names.count("candidates") <= 4


def test_parities_never_rule_out_a_similar_pair():
    rng = random.Random(23)
    for _ in range(80):
        a = words(rng, rng.randint(5, 300)) + ["once", "more"] * rng.randint(0, 9)
        texts = [" ".join(a), " ".join(edited(rng, a, rng.randint(0, 12)))]
        owner, hashes, counts = minhash_dedup.shingles(texts)
        bits = minhash_dedup.parities(owner, hashes, counts, 2)
        differ = int(np.bitwise_count((bits[0] ^ bits[1]).view(np.uint64)).sum())
        sizes = [counts[owner == i].sum() for i in (0, 1)]
        near = minhash_dedup.similarities(texts[:1], texts[1:])[0]
        assert differ <= sum(sizes) * (1 - near) / (1 + near) + 1e-6


def test_one_row_of_every_class_stays(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "A b c d e f g"), (None, "a b c d e f g"), (None, "alone here"), (3, ""), (3, ""), (4, None)]
    kept = minhash_dedup.drop_near_duplicates(frame(spark, rows))
    assert kept.columns == [f.split()[0] for f in DOCS.split(", ")]
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, "alone here"), (1, "a b c d e f g"), (3, ""), (3, ""), (4, "")]
    assert minhash_dedup.drop_near_duplicates(frame(spark, rows).limit(0)).count() == 0


def test_signatures_estimate_weighted_similarity():
    rng = random.Random(9)
    shared = total = 0
    exact = []
    for r in range(60):
        a = words(rng, 150) + ["same", "five", "words", "come", "again"] * rng.randint(1, 30)
        b = edited(rng, a, 20)
        texts = [" ".join(a), " ".join(b)]
        sig = minhash_dedup.signatures(*minhash_dedup.shingles(texts), 2)
        assert (sig != 0).all()
        shared += (sig[0] == sig[1]).sum()
        total += sig.shape[1]
        exact.append(minhash_dedup.similarities(texts[:1], texts[1:])[0])
    assert abs(shared / total - sum(exact) / len(exact)) < 0.03


def test_stars_take_no_round(spark, monkeypatch):
    names, plain = [], components.write_stage
    monkeypatch.setattr(components, "write_stage", lambda df, name: names.append(name) or plain(df, name))
    edges = [("a", "c"), ("b", "a"), ("a", "c"), ("d", "e"), ("f", "f")]
    got = {(r.node, r.comp) for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")} and len(names) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(f"{i:03d}", f"{i + 1:03d}") for i in range(40)] + [(f"{i:03d}", "200") for i in range(201, 260)]
    edges += [(f"{rng.randint(300, 340)}", f"{rng.randint(300, 340)}") for _ in range(25)]
    got = {r.node: r.comp for r in components.connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    parent = {}
    root = lambda x: x if parent.setdefault(x, x) == x else root(parent[x])
    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert got == {x: root(x) for x in nodes}


# ---- lines


def brute_lines(rows):
    seen, out = [], []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out.append((i, None, 0))
            continue
        kept, gone = [], 0
        for line in text.split("\n"):
            s = {w for w in line.replace("\t", " ").replace("\r", " ").split(" ") if w}
            again = bool(s) and any(5 * len(s & t) >= 4 * len(s | t) for t in seen)
            if s:
                seen.append(s)
            gone += again
            if not again:
                kept.append(line)
        out.append((i, "\n".join(kept), gone))
    return sorted(out, key=repr)


@pytest.mark.parametrize("dense", [200, 3])
def test_lines_are_removed_as_by_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    rng = random.Random(dense)
    common = ["the", "of", "and", "is", "to", "in", "a", "that"]
    pool = [words(rng, rng.randint(3, 30), 2) for _ in range(12)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            kind = rng.random()
            if kind < 0.5:
                base = list(rng.choice(pool))
                for _ in range(rng.choice([0, 1, 2, 5])):
                    base[rng.randrange(len(base))] = rng.choice(["qq", "rr", *common])
                rng.shuffle(base)
                lines.append(" ".join(base))
            elif kind < 0.8:
                lines.append(" ".join(rng.sample(common, rng.randint(1, 8))))
            else:
                lines.append(rng.choice(["", "  ", "\t", "x", "x\ty", "x y"]))
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "x " * 3000 + "\n" + " ".join(words(rng, 3000))), (None, "x\nonly here now")]
    got = line_dedup.remove_later_lines(frame(spark, rows))
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=repr) == brute_lines(rows)
    assert line_dedup.remove_later_lines(frame(spark, rows).limit(0)).count() == 0


def test_codes_of_a_line_are_sorted_as_plain_numbers(spark):
    ranks = F.array(*[F.lit(1 + i % 40).cast("bigint") for i in range(8)])
    rows = spark.createDataFrame([("b a  a c",), ("",), (None,)], "line string")
    got = rows.select(line_dedup._coded(line_dedup.words_of(F.col("line")), ranks).alias("set"))
    assert not got.schema["set"].dataType.containsNull  # else every number is boxed and compared as an object
    sets = [r.set for r in got.collect()]
    assert [s and len(s) for s in sets] == [3, [], None] and sets[0] == sorted(sets[0])


def test_a_class_is_found_in_the_band_above_at_few_places(spark):
    prefix = lambda n: list(range(n - (4 * n + 4) // 5 + 2))
    rows = spark.createDataFrame([(n, n, 0, 0, prefix(n)) for n in (33, 51, 60)], "id long, size int, parity long, parity2 long, prefix array<bigint>")
    got = sorted((r.id, r.own, r["count"]) for r in line_dedup._postings(rows).groupBy("id", "own").count().collect())
    # 33 words, a band's lower end, need no second key; 60 have 8 that a partner of 64 or more may not share.
    assert got == [(33, True, 7), (51, True, 11), (60, False, 5), (60, True, 13)]


@pytest.mark.parametrize("dense", [200, 1])
def test_lines_are_found_across_size_bands(spark, monkeypatch, dense):
    monkeypatch.setattr(line_dedup, "DENSE", dense)
    rng = random.Random(dense)
    rows = []
    for n in (8, 16, 33, 64, 65, 70, 78):
        base = words(rng, n, 9)
        for left in ((4 * n + 4) // 5, (4 * n + 4) // 5 - 1):  # just enough words, and one too few
            part = rng.sample(base, left)
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(part)), (len(rows) + 2, " ".join(part[1:] + ["new"]))][:: rng.choice([1, -1])]
    rows = list(enumerate(text for _, text in rows))
    got = line_dedup.remove_later_lines(frame(spark, rows))
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in got.collect()), key=repr) == brute_lines(rows)


def test_repeated_rows_are_one_document(spark):
    rows = [(1, "a b\nc d"), (1, "a b\nc d"), (2, "c d\ne")]
    got = sorted((r.doc_id, r.text, r.n_lines) for r in line_dedup.remove_later_lines(frame(spark, rows)).collect())
    assert got == [(1, "a b\nc d", 2), (1, "a b\nc d", 2), (2, "e", 2)]


# ---- passages


def test_passages_are_found_and_nothing_else(spark):
    rng = random.Random(3)
    passage = words(rng, 70)
    fuzzy = edited(rng, passage, 4)
    del fuzzy[33]
    short = words(rng, 30)
    rows = [(i, " ".join(words(rng, 90))) for i in range(40)]
    rows += [(50, " ".join(words(rng, 30) + passage + words(rng, 9))), (51, " ".join(words(rng, 200) + fuzzy)),
             (52, " ".join(passage)), (53, " ".join(short + words(rng, 60))), (54, " ".join(words(rng, 60) + short)),
             (55, None), (56, ""), (57, "Oure " * 500), (None, " ".join(passage)), (52, " ".join(passage))]
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {51, 52}
    assert (got[52].start_word, got[52].end_word, got[52].source_doc_id, got[52].source_start, got[52].identity) == (0, 70, 50, 30, 1.0)
    assert got[51].source_doc_id == 50 and got[51].end_word - got[51].start_word >= 60 and got[51].identity > 0.9
    assert substring_dedup.repeated_passages(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("parts", [[(0, 40), (40, 80)], [(0, 45), (5, 50)], [(0, 30), (20, 50), (10, 40)], [(0, 49), (1, 50)]])
def test_a_passage_whose_parts_have_earlier_holders(spark, parts):
    rng = random.Random(len(parts) + parts[0][1])
    rows, passages = [], {}
    for n in range(6):
        passage = words(rng, max(e for _, e in parts))
        for i, (s, e) in enumerate(parts):
            rows.append((100 * n + i, " ".join(words(rng, 20) + passage[s:e] + words(rng, 20))))
        rows += [(100 * n + i, " ".join(words(rng, 9 * i) + passage + words(rng, 30))) for i in (5, 9)]
        passages[100 * n + 9] = len(passage)
    got = {(r.doc_id, r.source_doc_id): r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == {(i, i - 4) for i in passages}
    assert all(r.start_word <= 81 and r.end_word >= 81 + passages[r.doc_id] and r.identity >= 0.95 for r in got.values())


def test_passages_down_to_the_least_identity(spark):
    rng = random.Random(31)
    rows, changed = [], []
    for n in range(10):
        base = words(rng, 62)
        for i, every in ((1, 5), (2, 6), (3, 8), (4, 10)):
            copy = [w if (k + 3) % every else f"zz{n}{i}{k}" for k, w in enumerate(base)]
            rows.append((100 * n + i, " ".join(words(rng, 12 * i) + copy + words(rng, 25))))
            changed.append(100 * n + i)
        rows.append((100 * n, " ".join(words(rng, 40) + base + words(rng, 40))))
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(frame(spark, rows)).collect()}
    assert set(got) == set(changed)
    assert all(r.source_doc_id // 100 == i // 100 and r.identity >= 0.8 and r.end_word - r.start_word >= 50 for i, r in got.items())


def test_chains_equal_quadratic_search():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(200):
        n = rng.integers(1, 9)
        start = rng.integers(0, 60, n)
        other = rng.integers(0, 60, n)
        size = rng.integers(6, 15, n)
        rows = np.stack([start, start + size, other, other + size], axis=1)
        rows = np.unique(rows, axis=0)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
        best = []
        for i, (s, e, os, oe) in enumerate(rows):
            before = [best[j] - substring_dedup.GAP_COST * (s - rows[j][1] + os - rows[j][3]) for j in range(i) if rows[j][1] <= s and rows[j][3] <= os]
            best.append(e - s + max([0.0, *before]))
        value = lambda c: sum(c[:, 1] - c[:, 0]) - substring_dedup.GAP_COST * sum(c[1:, 0] - c[:-1, 1] + c[1:, 2] - c[:-1, 3])
        found = substring_dedup.chains(rows)
        assert abs(value(found[0]) - max(best)) < 1e-9
        assert sum(len(c) for c in found) == len(rows)


@pytest.mark.parametrize("block", [1, 7, 64, 4096])
def test_gaps_are_matched_in_order_whatever_their_length(monkeypatch, block):
    def by_table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    rng = np.random.default_rng(block)
    for _ in range(60):
        a, b = (rng.integers(0, rng.integers(1, 30), rng.integers(0, 90)).astype(np.uint64) for _ in "ab")
        assert substring_dedup._matched(a, b) == by_table(a.tolist(), b.tolist())
    assert substring_dedup._matched(np.arange(450), np.arange(1, 451)) == 449
    mixed = rng.permutation(1199)
    assert substring_dedup._matched(np.arange(1199), mixed) == substring_dedup._matched(mixed, np.arange(1199)) < 100


def test_packed_seeds_give_back_every_shared_place(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BUCKET_CHARS", 600)
    rng = random.Random(31)
    text = lambda n: " ".join(rng.choice("abc") for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in (5, -7, 2**62, 9, 1, 12, -(2**62))] + [(9, text(40)), (20, "..."), (21, "")]
    rows += [rows[0], (30, "only here once and never again")]
    firsts, places = {}, []
    for row, (doc, t) in enumerate(rows):
        owner, hashes, pos = substring_dedup.seeds([t])
        for seed, at, first in zip(hashes.view(np.int64).tolist(), pos.tolist(), substring_dedup.first_places(owner, hashes)):
            places.append((seed, doc, at))
            if first:
                firsts.setdefault(seed, []).append((doc, at))
    want = sorted((seed, doc, at, *min(firsts[seed])) for seed, doc, at in places if len(firsts[seed]) > 1)
    got = substring_dedup._shared_places(frame(spark, rows).select("doc_id", "text").repartition(3))
    assert len(want) > 100 and sorted(map(tuple, got.collect())) == want


def test_packed_seeds_take_little_room(monkeypatch):
    monkeypatch.setattr(substring_dedup, "PACKED_SEEDS", 2_000)
    rng = random.Random(32)
    batch = pd.DataFrame({"doc_id": range(100, 150), "text": [" ".join(str(rng.random()) for _ in range(400)) for _ in range(50)]})
    parts = list(substring_dedup._packed_seeds(4)(iter([batch, batch[:0]])))
    assert len(parts) > 1
    packed = pd.concat(parts)
    n = sum(len(substring_dedup.seeds([t])[0]) for t in batch["text"])
    assert packed["n"].sum() == n
    assert sum(map(len, packed["seeds"])) + sum(map(len, packed["places"])) < 11 * n
    opened = [substring_dedup.unpack(*row) for row in zip(packed["n"], packed["n_texts"], packed["places"])]
    got = sorted(zip(np.concatenate([o[1] for o in opened]).tolist(), np.concatenate([o[2] for o in opened]).tolist()))
    assert got == sorted((100 + i, at) for i, t in enumerate(batch["text"]) for at in substring_dedup.seeds([t])[2].tolist())


def test_first_places():
    owner, hashes = np.array([0, 0, 0, 1, 1, 1]), np.array([7, 8, 7, 7, 9, 9], np.uint64)
    assert substring_dedup.first_places(owner, hashes).tolist() == [True, True, False, True, True, False]
    assert not substring_dedup.first_places(owner[:0], hashes[:0]).size


def test_a_passage_that_stands_twice_is_named_by_its_first_place(spark):
    rng = random.Random(8)
    passage, other = words(rng, 60), words(rng, 30)
    rows = [(1, " ".join(other + passage + other + passage)), (2, " ".join(words(rng, 20) + passage + words(rng, 20)))]
    for parts in (1, 5):
        got = substring_dedup.repeated_passages(frame(spark, rows).repartition(parts)).filter("doc_id = 2").collect()
        assert [(r.start_word, r.end_word, r.source_start, r.source_end) for r in got] == [(20, 80, 30, 90)]


def test_a_long_gap_is_matched_in_bounded_time_and_memory():
    import time

    rng = np.random.default_rng(5)
    a = rng.integers(0, 40_000, 20_000).astype(np.uint64)
    start = time.time()
    assert substring_dedup._matched(a, np.delete(a, [5, 77, 9_000])) == len(a) - 3
    assert time.time() - start < 10


def test_equal_runs_share_seeds():
    rng = random.Random(8)
    need = substring_dedup.K + substring_dedup.GUARD - 1
    for _ in range(100):
        run = words(rng, need)
        texts = [" ".join(words(rng, rng.randint(0, 40)) + run + words(rng, rng.randint(0, 40))) for _ in range(2)]
        owner, hashes, _ = substring_dedup.seeds(texts)
        assert set(hashes[owner == 0].tolist()) & set(hashes[owner == 1].tolist())


def test_words_do_not_depend_on_the_chunk(monkeypatch):
    texts = ["Ab c-d é", "", None, "ab C d É x", "C"]
    one = [cut([t or ""]).hashes.tolist() for t in texts]
    whole = cut([t or "" for t in texts])
    assert [whole.hashes[whole.owner == i].tolist() for i in range(len(texts))] == one
    assert one[0] == one[3][:4] and one[4] == one[3][1:2]
    monkeypatch.setattr("twinline.llm.words.CHUNK_CHARS", 5)
    assert [(i, list(c)) for i, c in chunks(texts)] == [(0, ["Ab c-d é"]), (1, ["", ""]), (3, ["ab C d É x"]), (4, ["C"])]


def test_changed_passage_whose_runs_all_stand_in_earlier_documents(spark):
    rng = np.random.default_rng(5)
    word = iter(f"w{i}" for i in rng.permutation(100_000))
    take = lambda n: [next(word) for _ in range(n)]
    passage = take(60)
    changed = [next(word) if i % 5 == 4 else w for i, w in enumerate(passage)]
    # Documents 1 to 12 hold one unchanged run of four words each, so every seed has another earliest holder.
    thieves = [(i + 1, " ".join(take(30) + passage[5 * i : 5 * i + 4] + take(30))) for i in range(12)]
    rows = [*thieves, (50, " ".join(take(40) + passage + take(40))), (70, " ".join(take(25) + changed + take(25)))]
    got = substring_dedup.repeated_passages(frame(spark, rows)).collect()
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.source_start, r.source_end) for r in got] == [(70, 50, 25, 84, 40, 99)]
    assert got[0].identity == pytest.approx(48 / 59)


def test_places_are_alike_as_the_words_around_them_are(spark):
    rng = np.random.default_rng(6)
    for n_changed in range(0, 11):
        text = [f"a{x}" for x in rng.integers(0, 10**9, 50)]
        other = [f"b{x}" if i in set(rng.choice(50, n_changed, False)) else w for i, (w, x) in enumerate(zip(text, rng.integers(0, 10**9, 50)))]
        words = substring_dedup.cut([" ".join(text), " ".join(other)])
        at = np.arange(47)
        bits = [substring_dedup.around(words, side)[k].view(np.int64).tolist() for side in (at, at + 50) for k in range(4)]
        rows = spark.createDataFrame(list(zip(*bits)), " long, ".join("abcdefgh") + " long")
        assert rows.filter(~substring_dedup.alike(list(zip("abcd", "efgh")))).count() == 0
    # Unlike words around the same four.
    words = substring_dedup.cut([" ".join([f"{s}{i}" if not 23 <= i < 27 else f"k{i}" for i in range(50)]) for s in "xy"])
    bits = [substring_dedup.around(words, np.array([at]))[k].view(np.int64).tolist() for at in (23, 73) for k in range(4)]
    rows = spark.createDataFrame(list(zip(*bits)), " long, ".join("abcdefgh") + " long")
    assert rows.filter(substring_dedup.alike(list(zip("abcd", "efgh")))).count() == 0
