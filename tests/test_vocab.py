from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from twinline.operators import codec, vocab as V
from twinline.sources import vocab_store

LINES = ["ab ab cd cd ef ef", "aaaa aaaa", "x"]


def _lines(spark, lines):
    return spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")


@pytest.fixture(scope="module")
def small(spark):
    return V.train_bpe(V.word_counts(_lines(spark, LINES)), vocab_size=16, min_frequency=2)


def _encode(spark, vocabulary, text, **kw):
    return codec.encode(_lines(spark, [text]), vocabulary, {"line": "ids"}, **kw).first().ids


def test_small_vocabulary(small):
    assert small.tokens() == [
        "[PAD]", "[UNK]", "[SOS]", "[EOS]", "a", "b", "c", "d", "e", "f", "x", "aa", "ab", "cd", "ef", "aaaa"
    ]


def test_encoding_literals(spark, small):
    assert _encode(spark, small, "zzab q") == [2, 1, 1, 12, 1, 3]
    assert _encode(spark, small, "ab cd ef ab", max_len=4) == [2, 12, 13, 3]
    assert _encode(spark, small, "") == [2, 3]
    assert _encode(spark, small, None) == [2, 3]
    assert _encode(spark, small, "ab[EOS]cd [PAD]") == [2, 12, 3, 13, 0, 3]


def test_decoding_literals(spark, small):
    df = spark.createDataFrame([([2, 12, 1, 13, 3, 0, 99],)], "ids array<int>")
    tokens = small.tokens()
    row = df.select(
        codec.decode(F.col("ids"), tokens).alias("a"), codec.decode(F.col("ids"), tokens, False).alias("b")
    ).first()
    assert row.a == "ab cd"
    assert row.b == "[SOS] ab [UNK] cd [EOS] [PAD]"


def test_alphabet_is_never_cut(spark):
    v = V.train_bpe(V.word_counts(_lines(spark, ["abcdefghij abcdefghij"])), vocab_size=6)
    assert len(v.tokens()) == 14
    assert v.merges.count() == 0


def test_min_frequency_stops(spark):
    v = V.train_bpe(V.word_counts(_lines(spark, ["ab ab cd"])), vocab_size=100, min_frequency=2)
    assert v.tokens()[4:] == ["a", "b", "c", "d", "ab"]


def test_single_letters_and_nothing(spark):
    assert V.train_bpe(V.word_counts(_lines(spark, ["a b"])), vocab_size=50).tokens()[4:] == ["a", "b"]
    assert V.train_bpe(V.word_counts(_lines(spark, [" "])), vocab_size=50).tokens()[4:] == []


def test_token_and_id_lookups(spark, small):
    asked = spark.createDataFrame([("ab",), ("zz",), ("[UNK]",)], "token string")
    assert {r.token: r.id for r in V.token_to_id(asked, small.vocab).collect()} == {"ab": 12, "zz": None, "[UNK]": 1}
    ids = spark.createDataFrame([(12,), (99,)], "id int")
    assert [r.token for r in V.id_to_token(ids, small.vocab).collect()] == ["ab"]
    assert V.vocab_size(small.vocab).first().vocab_size == 16


def test_special_id_contract(spark, small):
    V.check_special_ids(small.vocab)
    wrong = small.vocab.withColumn("id", F.when(F.col("id") == 2, 3).when(F.col("id") == 3, 2).otherwise(F.col("id")))
    with pytest.raises(RuntimeError, match=r"\[SOS\]"):
        V.check_special_ids(wrong)


def test_store(spark, small, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(FileNotFoundError):
        vocab_store.load_vocab(spark, path)
    vocab_store.save_vocab(small, path)
    back = vocab_store.load_vocab(spark, path)
    assert back.tokens() == small.tokens() and back.merge_rules() == small.merge_rules()
    # Saved without settings: loaded although the lines differ. Forced: trained again.
    other = _lines(spark, ["zz zz"])
    assert vocab_store.get_or_train_vocab(other, path).tokens() == small.tokens()
    assert vocab_store.get_or_train_vocab(other, path, force=True).tokens()[4:] == ["z", "zz"]


def test_other_settings_train_again_and_versions_stay(spark, tmp_path):
    path, lines, other = str(tmp_path / "v"), _lines(spark, LINES), _lines(spark, ["zz zz"])
    first = vocab_store.get_or_train_vocab(lines, path, vocab_size=13).tokens()
    assert vocab_store.get_or_train_vocab(other, path, vocab_size=13).tokens() == first
    assert len(vocab_store.get_or_train_vocab(lines, path, vocab_size=14).tokens()) == 14
    assert vocab_store.get_or_train_vocab(other, path, vocab_size=14, follow_corpus=True).tokens()[4:] == ["z", "zz"]
    assert vocab_store.get_or_train_vocab(other, path, vocab_size=14, follow_corpus=True).tokens()[4:] == ["z", "zz"]
    assert [n for n, *_ in vocab_store._published(spark, path)] == [1, 2, 3]
    # A version that was written but not published, as by a writer that died, is not seen.
    (tmp_path / "v" / "versions" / "half" / "merges").mkdir(parents=True)
    assert vocab_store.load_vocab(spark, path).tokens()[4:] == ["z", "zz"]


def test_the_json_file_is_shared_with_the_tokenizers_package(spark, small, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = vocab_store.export_json(small, str(tmp_path / "v.json"))
    theirs = tokenizers.Tokenizer.from_file(path)
    for text in ("ab cd EF ab", "zzab q", "", "aaaa[EOS]x"):
        assert theirs.encode(text).ids == _encode(spark, small, text)
    theirs.save(str(tmp_path / "again.json"))
    back = vocab_store.import_json(spark, str(tmp_path / "again.json"))
    assert back.tokens() == small.tokens() and back.merge_rules() == small.merge_rules()
    # Older files hold a merge as one string.
    import json

    content = json.loads((tmp_path / "v.json").read_text())
    content["model"]["merges"] = [" ".join(m) for m in content["model"]["merges"]]
    (tmp_path / "old.json").write_text(json.dumps(content))
    assert vocab_store.import_json(spark, str(tmp_path / "old.json")).merge_rules() == small.merge_rules()
    with pytest.raises(FileNotFoundError):
        vocab_store.import_json(spark, str(tmp_path / "none.json"))


def test_rewriting_and_short_fetches_change_nothing(spark, small):
    words = V.word_counts(_lines(spark, LINES))
    again = V.train_bpe(words, vocab_size=16, fetch=2, rewrite_after=1)
    assert again.tokens() == small.tokens() and again.merge_rules() == small.merge_rules()


def _plain_merges(counts: dict[str, int], size: int) -> list[tuple[str, str]]:
    """One merge at a time over all words, best pair first, ties by the order of ids."""
    words = [(list(w), n) for w, n in counts.items()]
    rank = {c: i for i, c in enumerate(sorted({c for w in counts for c in w}))}
    merges = []
    while len(rank) + 4 < size:
        pairs = {}
        for w, n in words:
            for pair in zip(w, w[1:]):
                pairs[pair] = pairs.get(pair, 0) + n
        best = min(pairs, key=lambda p: (-pairs[p], rank[p[0]], rank[p[1]]), default=None)
        if best is None or pairs[best] < 2:
            break
        merges.append(best)
        rank.setdefault("".join(best), len(rank))
        for w, _ in words:
            i = 0
            while i + 1 < len(w):
                if (w[i], w[i + 1]) == best:
                    w[i : i + 2] = ["".join(best)]
                i += 1
    return merges


@pytest.mark.parametrize("indexed, named", [(False, {"fetch": 5}), (True, {}), (True, {"rewrite_after": 7, "fetch": 40})])
def test_maintained_counts_choose_as_full_counts_do(spark, monkeypatch, named, indexed):
    # With postings from the first pass on, and never: the same merges as counting everything anew.
    monkeypatch.setattr(V, "INDEX_AFTER", 0 if indexed else 10**6)
    monkeypatch.setattr(V, "POSTED_PAIRS", 3 if indexed else 8)
    rng = random.Random(4)
    counts = {"".join(rng.choice("abcdee") for _ in range(rng.randrange(1, 12))): rng.choice([1, 2, 3, 50]) for _ in range(120)}
    counts |= {"aaaa": 9, "aaa": 8, "abababab": 7}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    v = V.train_bpe(words, 40, **named)
    tokens = v.tokens()
    assert [(tokens[a], tokens[b]) for a, b, _ in v.merge_rules()] == _plain_merges(counts, 40)


def test_postings_are_read_by_pair_and_changes_follow_changed_words(spark, monkeypatch):
    monkeypatch.setattr(V, "INDEX_AFTER", 0)
    framed = spark.createDataFrame([(1, " 97  98 "), (2, " 98  99  97 "), (3, " 97  98  99 ")], "n long, s string")
    table = V._Words(framed)
    assert table.merge([(97, 98, 900)]) == {(97, 98): -4, (98, 99): -3, (900, 99): 3}
    assert sorted(r.s for r in table._holders([(900, 99, 901)]).collect()) == [" 97  98  99 ", " 98  99  97 "]
    assert table.merge([(900, 99, 901)]) == {(900, 99): -3}
    plan = table._holders([(98, 99, 902)])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(pair), EqualTo(pair," in plan
    table.rewrite()
    assert sorted((r.n, r.s) for r in table.base.collect()) == [(2, " 98  99  97 ")]
    table.drop()


@pytest.fixture(scope="module")
def real_lines(spark):
    text = (
        "The baker's three small ovens glow near the old harbour wall. Drei kleine Öfen der Bäckerei glühen "
        "neben der alten Hafenmauer. The gulls are circling; die Möwen kreisen über dem Meer! "
        "Straße straße STRASSE Größe größer am größten, 12-year-old 3.14 a_b 🙂🙂 été aaaaaaa aaaa aaa"
    ).split(". ")
    return [" ".join(w for w in line.split()) for line in text] * 3 + [line[::-1] for line in text]


def test_training_and_encoding_match_the_tokenizers_package(spark, real_lines):
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import models, normalizers, pre_tokenizers, processors, trainers

    tok = tokenizers.Tokenizer(models.BPE(unk_token="[UNK]"))
    tok.normalizer = normalizers.Lowercase()
    tok.pre_tokenizer = pre_tokenizers.Whitespace()
    trainer = trainers.BpeTrainer(
        vocab_size=150, min_frequency=2, show_progress=False, special_tokens=["[PAD]", "[UNK]", "[SOS]", "[EOS]"]
    )
    tok.train_from_iterator(real_lines, trainer=trainer)
    tok.post_processor = processors.TemplateProcessing(
        single="[SOS] $A [EOS]", special_tokens=[("[SOS]", 2), ("[EOS]", 3)]
    )
    mine = V.train_bpe(V.word_counts(_lines(spark, real_lines)), vocab_size=150)
    vocab = tok.get_vocab()
    assert mine.tokens() == sorted(vocab, key=vocab.get)
    probes = real_lines + ["unseen Wörter ñ 漢字", "[EOS] mid [UNK] x[SOS]y", "", "  \t ", "ΑΣ größeren", "aaaaaaaaaaaaaaaaaaaaaaa hafenmauer" * 40]
    got = codec.encode(_lines(spark, probes), mine, {"line": "ids"}).orderBy("i").collect()
    for row, text in zip(got, probes):
        assert row.ids == tok.encode(text).ids, text


def test_joined_and_narrow_encoding_agree(spark, real_lines):
    lines = _lines(spark, real_lines + ["", "   ", "[EOS] zz"])
    words = V.word_counts(lines)
    v = V.train_bpe(words, vocab_size=120)
    dictionary = codec.encode_words(words, v)
    narrow = {r.i: r.ids for r in codec.encode(lines, v, {"line": "ids"}).collect()}
    for hot in (1, 10_000):
        joined = {r.i: r.ids for r in codec.known_word_encode(lines, dictionary, ["i"], "line", hot_words=hot).collect()}
        assert joined == narrow


def test_words_that_are_frequent_only_in_the_text_are_shared(spark):
    # The dictionary has never seen the most frequent word, nor a very long one.
    v = V.train_bpe(V.word_counts(_lines(spark, LINES)), vocab_size=16)
    dictionary = codec.encode_words(spark.createDataFrame([("ab", 2), ("cd", 2)], "word string, n long"), v)
    texts = ["zz ab zz cd zz zz [EOS] q", "zz " * 500, "", None, "ab", "long " + "b" * 3000, "cd q q ab zz"]
    rows = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "i int, line string")
    assert codec.frequent_words(rows.filter("i = 1"), 2, "line") == ["zz"]

    def expected(text):
        ids = {"ab": [12], "cd": [13], "[EOS]": [3]}
        return [2, *[x for w in (text or "").split() for x in ids.get(w, [1] * len(w))], 3]

    for hot in (1, 3, 10_000):
        coded = codec.known_word_encode(rows, dictionary, ["i"], "line", hot_words=hot)
        assert {r.i: r.ids for r in coded.collect()} == {i if i else None: expected(t) for i, t in enumerate(texts)}
        plan = coded._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate ") == 1 and "explode(others" in plan


def test_a_worker_holds_the_ids_of_a_slice_only(spark, small):
    lines = ["ab ba <unk> " * (i % 7) for i in range(2 * codec.SLICE_ROWS + 5)]
    cut = codec.word_encoder(small).func
    parts = list(cut(iter([pa.array(lines), pa.array(lines[:3])])))
    assert [len(p) for p in parts] == [codec.SLICE_ROWS, codec.SLICE_ROWS, 5, 3]
    whole = [ids for p in parts for ids in p.to_pylist()]
    assert whole[: len(lines)] == [next(iter(cut(iter([pa.array([line])])))).to_pylist()[0] for line in lines] and whole[len(lines) :] == whole[:3]
    rows = spark.createDataFrame(list(enumerate(lines)), "i int, t string").coalesce(1)
    got = codec.encode(rows, small, {"t": "ids"}, add_special=False).collect()
    assert [r.ids for r in sorted(got)] == whole[: len(lines)]
