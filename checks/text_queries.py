"""Sources, sinks, cleaning, text functions, vocabulary and codec."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinline.functions import ids as I
from twinline.functions.text import normalize, pre_tokenize, strip_text
from twinline.operators import codec, lengths, pairs as P, vocab as V
from twinline.operators.map_lines import map_lines
from twinline.plans.stages import new_path, write_stage
from twinline.sources import lines as L, pairs as SP, vocab_store
from twinline.streaming.lines import stream_map_lines

from . import views
from .registry import check
from .views import RE2_BREAK, joined, six, sql_join, sql_strip, sql_words, table, with_views

def _records(spark: SparkSession, sf: str) -> str:
    """Path of a table of nested records: every two lines of every document; an odd last line has an empty mate."""
    path = new_path(spark, "nested-records")
    views.line_pairs(spark, sf).select("pair_id", F.struct("en", "de").alias("translation")).write.parquet(path)
    return path


def _extra(spark: SparkSession, sf: str, cap: int | None = None) -> DataFrame:
    return SP.read_extra(spark, {"book_lines": SP.ExtraSource(_records(spark, sf))}, "book_lines", cap)


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    return P.merge_train_extra(views.pairs(spark, sf), _extra(spark, sf))


# ---- sources and sinks -----------------------------------------------------------------


@check("a1_read_pairs", with_views("pairs") + "SELECT pair_id, split, src, tgt FROM pairs")
def a1(spark, sf):
    path = new_path(spark, "base-corpus")
    views.pairs(spark, sf).write.partitionBy("split").parquet(path)
    return SP.read_pairs(spark, path)


@check("a2_read_extra", with_views("extra", "kept_extra") + "SELECT * FROM kept_extra")
def a2(spark, sf):
    return _extra(spark, sf)


@check("j2_pluggable_extractor", with_views("extra", "kept_extra") + "SELECT * FROM kept_extra")
def j2(spark, sf):
    registry = {
        "nested": SP.ExtraSource(
            _records(spark, sf), key=F.col("pair_id"), source=F.col("translation.en"), target=F.col("translation.de")
        )
    }
    return SP.read_extra(spark, registry, "nested")


_CORPUS_LINES = {
    "corpus": f"""
        SELECT 1 AS part, pair_id, 0 AS side, {sql_strip("src")} AS line FROM merged WHERE split='train' AND origin='base'
        UNION ALL SELECT 1, pair_id, 1, {sql_strip("tgt")} FROM merged WHERE split='train' AND origin='base'
        UNION ALL SELECT 2, pair_id, 0, src FROM kept_extra
        UNION ALL SELECT 2, pair_id, 1, tgt FROM kept_extra""",
}


@check(
    "a3_write_corpus",
    with_views("pairs", "extra", "kept_extra", "merged", more=_CORPUS_LINES)
    + f"""SELECT row_number() OVER (ORDER BY part, pair_id, side, i) AS line_no, line
          FROM (SELECT part, pair_id, side, generate_subscripts(l,1) AS i, unnest(l) AS line
                FROM (SELECT part, pair_id, side, string_split_regex(line, '{RE2_BREAK}') AS l FROM corpus))""",
)
def a3(spark, sf):
    path, _ = L.write_corpus(_merged(spark, sf), new_path(spark, "corpus"))
    return L.read_numbered_lines(spark, path)


@check(
    "a4_read_lines",
    with_views("lines") + f"SELECT line FROM (SELECT {sql_strip('line')} AS line FROM lines) WHERE length(line)>0",
)
def a4(spark, sf):
    path = new_path(spark, "document-lines")
    table(spark, sf, "documents").select("text").write.text(path)
    return L.read_lines(spark, path)


@check(
    "a5_read_numbered_lines",
    f"""SELECT row_number() OVER (ORDER BY doc_id, i) AS line_no, line
        FROM (SELECT doc_id, generate_subscripts(l,1) AS i, unnest(l) AS line
              FROM (SELECT doc_id, string_split_regex(text, '{RE2_BREAK}') AS l FROM documents))""",
)
def a5(spark, sf):
    path = new_path(spark, "ordered-lines")
    table(spark, sf, "documents").orderBy("doc_id").select("text").write.text(path)
    return L.read_numbered_lines(spark, path)


@check(
    "a8_write_translations",
    with_views("pairs", more={
        "numbered": "SELECT row_number() OVER (ORDER BY pair_id) AS n, replace(tgt, chr(10), ' ') AS t FROM pairs",
    })
    + "SELECT n AS line_no, t AS line FROM numbered",
)
def a8(spark, sf):
    flat = views.numbered(views.pairs(spark, sf), ["pair_id"]).select(
        "line_no", F.translate("tgt", "\n", " ").alias("text")
    )
    return L.read_numbered_lines(spark, L.write_translations(flat, new_path(spark, "translations")))


# ---- cleaning, merging, counting -------------------------------------------------------


@check(
    "b1_strip_text",
    with_views("lines")
    + f"SELECT doc_id, line_no, {sql_strip('concat(chr(160), chr(9), line, chr(8195), chr(10))')} AS line FROM lines",
)
def b1(spark, sf):
    framed = F.concat(F.lit("\xa0\t"), F.col("line"), F.lit(" \n"))
    return views.lines(spark, sf).select("doc_id", "line_no", strip_text(framed).alias("line"))


@check("b2_drop_empty_pairs", with_views("extra", "kept_extra") + "SELECT pair_id, src, tgt FROM kept_extra")
def b2(spark, sf):
    raw = views.line_pairs(spark, sf).select("pair_id", F.col("en").alias("src"), F.col("de").alias("tgt"))
    return P.drop_empty_pairs(P.strip_pairs(raw))


@check(
    "b3_cap_pairs",
    with_views("extra", "kept_extra") + "SELECT pair_id, src, tgt FROM kept_extra ORDER BY pair_id LIMIT 150",
)
def b3(spark, sf):
    return _extra(spark, sf, 150).select("pair_id", "src", "tgt")


@check(
    "d1_split_counts",
    with_views("pairs", "extra", "kept_extra", "merged")
    + """SELECT split, coalesce(origin,'all') AS origin, count(*) AS n_pairs
         FROM merged GROUP BY GROUPING SETS ((split, origin), (split))""",
)
def d1(spark, sf):
    return P.split_counts(_merged(spark, sf))


@check(
    "d17_batch_counts",
    with_views("pairs")
    + """SELECT split, count(*) AS n_pairs,
                CAST(CASE WHEN split='train' THEN floor(count(*)/64.0) ELSE ceil(count(*)/64.0) END AS BIGINT) AS n_batches
         FROM pairs GROUP BY split""",
)
def d17(spark, sf):
    return P.batch_counts(views.pairs(spark, sf), 64)


@check(
    "g1_merge_train_extra",
    with_views("pairs", "extra", "kept_extra", "merged") + "SELECT pair_id, split, origin, src, tgt FROM merged",
)
def g1(spark, sf):
    return _merged(spark, sf).select("pair_id", "split", "origin", "src", "tgt")


@check(
    "g2_interleave_lines",
    with_views("pairs", "extra", "kept_extra", "merged", more=_CORPUS_LINES)
    + "SELECT part, pair_id, side, line FROM corpus",
)
def g2(spark, sf):
    return P.interleave_lines(_merged(spark, sf))


# ---- text functions --------------------------------------------------------------------


@check("h1_normalize", with_views("lines") + "SELECT doc_id, line_no, lower(replace(line,'Σ','σ')) AS line FROM lines")
def h1(spark, sf):
    return views.lines(spark, sf).select("doc_id", "line_no", normalize(F.col("line")).alias("line"))


@check(
    "h2_pre_tokenize",
    with_views("lines") + f"SELECT doc_id, line_no, array_to_string({sql_words('line')}, ' ') AS words FROM lines",
)
def h2(spark, sf):
    words = pre_tokenize(normalize(F.col("line")))
    return views.lines(spark, sf).select("doc_id", "line_no", F.array_join(words, " ").alias("words"))


@check("d2_word_counts", with_views("lines", "words") + "SELECT word, n FROM words")
def d2(spark, sf):
    return V.word_counts(views.lines(spark, sf))


@check("d3_alphabet", with_views("lines", "words", "doc_alphabet") + "SELECT id, token FROM doc_alphabet")
def d3(spark, sf):
    return V.alphabet(V.word_counts(views.lines(spark, sf)))


@check(
    "d4_pair_counts",
    with_views("lines", "words")
    + """SELECT word[i] AS "left", word[i+1] AS "right", CAST(sum(n) AS BIGINT) AS n
         FROM (SELECT word, n, unnest(range(1, length(word))) AS i FROM words) GROUP BY ALL""",
)
def d4(spark, sf):
    return V.pair_counts(V.word_counts(views.lines(spark, sf)))


# ---- vocabulary learning: the SQL is unrolled, one merge per common table expression -----

MERGES = 8
#: Merges of the learning query itself: more than are left pending, so that the table is rewritten.
LONG_MERGES = 64


def _unrolled_merges(merges: int = MERGES) -> dict[str, str]:
    more = {
        "m_alphabet": """
            SELECT CAST(3+row_number() OVER (ORDER BY token) AS INTEGER) AS id, token
            FROM (SELECT DISTINCT unnest(string_split(word,'')) AS token FROM train_words)""",
        "m_map": "SELECT map(list(token), list(id)) AS m, max(id) AS top FROM m_alphabet",
        "m_s0": """
            SELECT n, concat(' ', array_to_string([m[c] for c in string_split(word,'')], '  '), ' ') AS s
            FROM train_words, m_map""",
    }
    for k in range(1, merges + 1):
        more[f"m_p{k}"] = f"""
            SELECT {k-1} AS rank, l AS left_id, r AS right_id, (SELECT top FROM m_map)+{k} AS new_id
            FROM (SELECT a[i]::INTEGER AS l, a[i+1]::INTEGER AS r, n
                  FROM (SELECT a, n, unnest(range(1, len(a))) AS i
                        FROM (SELECT string_split(trim(s), '  ') AS a, n FROM m_s{k-1})))
            GROUP BY l, r HAVING sum(n)>=2 ORDER BY sum(n) DESC, l, r LIMIT 1"""
        more[f"m_s{k}"] = f"""
            SELECT n, replace(s, concat(' ',left_id,'  ',right_id,' '), concat(' ',new_id,' ')) AS s
            FROM m_s{k-1}, m_p{k}"""
    more["m_rules"] = " UNION ALL ".join(f"SELECT * FROM m_p{k}" for k in range(1, merges + 1))
    more["m_v0"] = """SELECT id, token FROM m_alphabet UNION ALL
            SELECT * FROM (VALUES (0,'[PAD]'),(1,'[UNK]'),(2,'[SOS]'),(3,'[EOS]'))"""
    for k in range(1, merges + 1):
        more[f"m_v{k}"] = f"""
            SELECT * FROM m_v{k-1} UNION ALL
            SELECT new_id, concat((SELECT token FROM m_v{k-1} WHERE id=left_id), (SELECT token FROM m_v{k-1} WHERE id=right_id))
            FROM m_p{k}"""
    return more


_LEARNED = with_views("pairs", "train_words", more=_unrolled_merges())


def _in_rank_order(s: str) -> str:
    for k in range(1, MERGES + 1):
        key = f"(SELECT concat(' ',left_id,'  ',right_id,' ') FROM m_p{k})"
        s = f"replace({s}, {key}, (SELECT concat(' ',new_id,' ') FROM m_p{k}))"
    return s


def _sql_ids(words: str) -> str:
    """The ids of a word list as text: blank-framed symbols, words kept apart by bars."""
    framed = f"array_to_string([concat(' ', array_to_string([coalesce(m[c],1) for c in string_split(w,'')], '  '), ' ') for w in {words}], '|')"
    return f"trim(regexp_replace(replace({_in_rank_order(framed)}, '|', ' '), ' +', ' ', 'g'))"


def _learned(spark: SparkSession, sf: str, merges: int = MERGES, **named) -> V.Vocabulary:
    counts, _ = write_stage(V.word_counts(views.train_lines(spark, sf)), "train-words")
    size = 4 + V.alphabet(counts).count() + merges
    return V.train_bpe(counts, vocab_size=size, **named)


@check("d5_train_bpe", _LEARNED + "SELECT rank, left_id, right_id, new_id FROM m_rules")
def d5(spark, sf):
    return _learned(spark, sf).merges


@check(
    "d5_train_bpe_rewritten",
    with_views("pairs", "train_words", more=_unrolled_merges(LONG_MERGES)) + "SELECT rank, left_id, right_id, new_id FROM m_rules",
)
def d5_rewritten(spark, sf):
    return _learned(spark, sf, LONG_MERGES, rewrite_after=24).merges


@check("a6_save_load_vocab", _LEARNED + f"SELECT id, token FROM m_v{MERGES}")
def a6(spark, sf):
    path = vocab_store.save_vocab(_learned(spark, sf), new_path(spark, "vocabulary"))
    return vocab_store.load_vocab(spark, path).vocab


@check("a6_json_vocabulary", _LEARNED + f"SELECT v.id, token, rank FROM m_v{MERGES} v LEFT JOIN m_rules ON new_id=v.id")
def a6_json(spark, sf):
    path = vocab_store.export_json(_learned(spark, sf), f"{new_path(spark, 'vocabulary')}.json")
    back = vocab_store.import_json(spark, path)
    return back.vocab.join(back.merges.select(F.col("new_id").alias("id"), "rank"), "id", "left")


@check("a7_get_or_train_vocab", _LEARNED + f"SELECT id, token FROM m_v{MERGES}")
def a7(spark, sf):
    lines = views.train_lines(spark, sf)
    size = 4 + V.alphabet(V.word_counts(lines)).count() + MERGES
    path = new_path(spark, "vocabulary")
    vocab_store.get_or_train_vocab(lines, path, vocab_size=size)
    return vocab_store.get_or_train_vocab(lines, path, vocab_size=size).vocab


@check("d19_vocab_size", _LEARNED + f"SELECT count(*) AS vocab_size FROM m_v{MERGES}")
def d19(spark, sf):
    return V.vocab_size(_learned(spark, sf).vocab)


@check(
    "d18_check_special_ids",
    with_views("pairs", "toy")
    + """SELECT e.token, e.expected_id::INTEGER AS expected_id, t.id AS actual_id
         FROM (VALUES ('[PAD]',0),('[UNK]',1),('[SOS]',2),('[EOS]',3)) e(token, expected_id)
         LEFT JOIN toy t USING (token) WHERE t.id IS DISTINCT FROM e.expected_id""",
)
def d18(spark, sf):
    # The bare alphabet has no special tokens, so all four are reported.
    return V.special_id_mismatches(V.alphabet(V.word_counts(views.pairs(spark, sf), "src")))


_ENCODED = f"""SELECT pair_id, concat('2 ', {_sql_ids(sql_words("src"))}, ' 3') AS src_ids,
        concat('2 ', {_sql_ids(sql_words("tgt"))}, ' 3') AS tgt_ids FROM pairs, m_map"""


@check("h3_encode", _LEARNED + _ENCODED)
def h3(spark, sf):
    encoded = codec.encode(views.pairs(spark, sf), _learned(spark, sf), {"src": "src_ids", "tgt": "tgt_ids"})
    return encoded.select("pair_id", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids"))


def _dictionary(spark: SparkSession, sf: str) -> DataFrame:
    counts, _ = write_stage(V.word_counts(views.train_lines(spark, sf)), "train-words")
    size = 4 + V.alphabet(counts).count() + MERGES
    dictionary, _ = write_stage(codec.encode_words(counts, V.train_bpe(counts, size)), "dictionary")
    return dictionary


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("src").alias("text")),
                             F.struct(F.lit(1).alias("side"), F.col("tgt").alias("text"))))
    return views.pairs(spark, sf).select("pair_id", both.alias("s")).select("pair_id", "s.side", "s.text")


_DICTIONARY = {
    "m_dict": f"SELECT word, {_sql_ids('[word]')} AS ids FROM train_words, m_map",
    "tok": f"""SELECT pair_id, side, generate_subscripts(ws,1) AS pos, unnest(ws) AS word FROM
                 (SELECT pair_id, 0 AS side, {sql_words('src')} AS ws FROM pairs
                  UNION ALL SELECT pair_id, 1, {sql_words('tgt')} FROM pairs)""",
}


@check(
    "c6_known_word_encode",
    with_views("pairs", "train_words", more=_unrolled_merges() | _DICTIONARY)
    + """SELECT pair_id, side,
                concat('2 ', string_agg(coalesce(ids, trim(repeat('1 ', length(word)))), ' ' ORDER BY pos), ' 3') AS ids
         FROM tok LEFT JOIN m_dict USING (word) GROUP BY pair_id, side""",
)
def c6(spark, sf):
    # A small hot list, so that both the broadcast and the shuffled part do work.
    coded = codec.known_word_encode(
        _sides(spark, sf), _dictionary(spark, sf), ["pair_id", "side"], "text", hot_words=100
    )
    return coded.select("pair_id", "side", joined("ids").alias("ids"))


@check(
    "d10_word_fertility",
    _LEARNED + f"""SELECT word, n, CAST(len(string_split({_sql_ids('[word]')}, ' ')) AS INTEGER) AS n_tokens
                   FROM train_words, m_map""",
)
def d10(spark, sf):
    return lengths.word_fertility(_dictionary(spark, sf))


@check(
    "d10_mean_fertility",
    _LEARNED + f"""SELECT round(sum(n*k)/sum(n),6) AS tokens_per_word, CAST(sum(n) AS BIGINT) AS n_words
                   FROM (SELECT n, len(string_split({_sql_ids('[word]')}, ' ')) AS k FROM train_words, m_map)""",
)
def d10_mean(spark, sf):
    return lengths.mean_fertility(_dictionary(spark, sf)).select(six("tokens_per_word").alias("tokens_per_word"), "n_words")


# ---- ids of the character vocabulary -----------------------------------------------------

_TOY = ("pairs", "toy", "toy_map", "toy_pairs")


@check(
    "b4_truncate_ids",
    with_views(*_TOY, "cut_pairs") + f"SELECT pair_id, {sql_join('src_ids')} AS src_ids, {sql_join('tgt_ids')} AS tgt_ids FROM cut_pairs",
)
def b4(spark, sf):
    cut = views.toy_pairs(spark, sf).select(
        "pair_id", *[I.truncate_ids(F.col(c), 128).alias(c) for c in ("src_ids", "tgt_ids")]
    )
    return cut.select("pair_id", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids"))


@check(
    "b5_encode_batch_max_length",
    with_views(*_TOY, more={
        "cut": "SELECT pair_id, CASE WHEN len(src_all)>48 THEN list_concat(src_all[1:47],[3]) ELSE src_all END AS ids FROM toy_pairs",
        "wide": "SELECT pair_id, list_concat(ids, [0 for i in range(max(len(ids)) OVER () - len(ids))]) AS ids FROM cut",
    })
    + f"SELECT pair_id, {sql_join('ids')} AS ids, {sql_join('[(x<>0)::INTEGER for x in ids]')} AS attention_mask FROM wide",
)
def b5(spark, sf):
    batch = codec.encode_batch(views.pairs(spark, sf), views.toy_vocabulary(spark, sf), "src", max_len=48)
    return batch.select("pair_id", joined("ids").alias("ids"), joined("attention_mask").alias("attention_mask"))


@check(
    "e5_encode_batch",
    with_views(*_TOY, more={
        "wide": """SELECT split, pair_id, list_concat(src_all, [0 for i in range(max(len(src_all)) OVER (PARTITION BY split) - len(src_all))]) AS ids
                   FROM toy_pairs""",
    })
    + f"SELECT split, pair_id, {sql_join('ids')} AS ids, {sql_join('[(x<>0)::INTEGER for x in ids]')} AS attention_mask FROM wide",
)
def e5(spark, sf):
    batch = codec.encode_batch(views.pairs(spark, sf), views.toy_vocabulary(spark, sf), "src", ["split"])
    return batch.select("split", "pair_id", joined("ids").alias("ids"), joined("attention_mask").alias("attention_mask"))


_BY_64 = f"SELECT pair_id, batch, {sql_join('ids')} AS ids, {sql_join('[(x<>0)::INTEGER for x in ids]')} AS attention_mask FROM wide"


def _batch_of_64(spark, sf, max_len=None):
    """Batches of 64 consecutive pair ids, each padded to its own longest row."""
    rows = views.pairs(spark, sf).withColumn("batch", F.floor(F.col("pair_id") / 64))
    batch = codec.encode_batch(rows, views.toy_vocabulary(spark, sf), "src", ["batch"], max_len)
    return batch.select("pair_id", "batch", joined("ids").alias("ids"), joined("attention_mask").alias("attention_mask"))


@check(
    "b5_encode_batch_by_64_max_length",
    with_views(*_TOY, more={
        "cut": "SELECT pair_id, pair_id // 64 AS batch, CASE WHEN len(src_all)>48 THEN list_concat(src_all[1:47],[3]) ELSE src_all END AS ids FROM toy_pairs",
        "wide": "SELECT pair_id, batch, list_concat(ids, [0 for i in range(max(len(ids)) OVER (PARTITION BY batch) - len(ids))]) AS ids FROM cut",
    })
    + _BY_64,
)
def b5_by_64(spark, sf):
    return _batch_of_64(spark, sf, max_len=48)


@check(
    "e5_encode_batch_by_64",
    with_views(*_TOY, more={
        "wide": """SELECT pair_id, pair_id // 64 AS batch, list_concat(src_all, [0 for i in range(max(len(src_all)) OVER (PARTITION BY pair_id // 64) - len(src_all))]) AS ids
                   FROM toy_pairs""",
    })
    + _BY_64,
)
def e5_by_64(spark, sf):
    return _batch_of_64(spark, sf)


@check(
    "b6_strip_special_ids",
    with_views(*_TOY) + f"SELECT pair_id, {sql_join('[x for x in tgt_all if x>3]')} AS ids FROM toy_pairs",
)
def b6(spark, sf):
    return views.toy_pairs(spark, sf).select("pair_id", joined(I.strip_special_ids(F.col("tgt_ids"))).alias("ids"))


@check(
    "b7_cut_at_eos",
    with_views(*_TOY) + f"SELECT pair_id, {sql_join('src_all[1:len(src_all)-1]')} AS ids FROM toy_pairs",
)
def b7(spark, sf):
    both = F.concat("src_ids", "tgt_ids")
    return views.toy_pairs(spark, sf).select("pair_id", joined(I.cut_at_eos(both)).alias("ids"))


@check(
    "b9_wrap_special",
    with_views(*_TOY) + f"SELECT pair_id, {sql_join('src_all')} AS ids FROM toy_pairs",
)
def b9(spark, sf):
    bare = codec.encode(
        views.pairs(spark, sf), views.toy_vocabulary(spark, sf), {"src": "bare"}, add_special=False
    )
    return bare.select("pair_id", joined(I.wrap_special(F.col("bare"))).alias("ids"))


@check(
    "b10_wrap_special_pair",
    with_views(*_TOY) + f"SELECT pair_id, {sql_join('list_concat(src_all, tgt_all)')} AS ids FROM toy_pairs",
)
def b10(spark, sf):
    bare = codec.encode(
        views.pairs(spark, sf), views.toy_vocabulary(spark, sf), {"src": "a", "tgt": "b"}, add_special=False
    )
    return bare.select("pair_id", joined(I.wrap_special_pair(F.col("a"), F.col("b"))).alias("ids"))


@check(
    "c1_token_to_id",
    with_views("lines", "words", "pairs", "toy")
    + """SELECT c.token, c.n, t.id FROM
           (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(string_split(word,'')) AS token, n FROM words) GROUP BY token) c
         LEFT JOIN toy t USING (token)""",
)
def c1(spark, sf):
    words = V.word_counts(views.lines(spark, sf))
    characters = words.select("n", F.explode(F.split("word", "")).alias("token")).groupBy("token").agg(F.sum("n").alias("n"))
    return V.token_to_id(characters, views.toy_vocabulary(spark, sf).vocab).select("token", "n", "id")


@check(
    "c2_id_to_token",
    with_views(*_TOY)
    + """SELECT pair_id, pos, token FROM
           (SELECT pair_id, CAST(generate_subscripts(src_all,1)-1 AS INTEGER) AS pos, unnest(src_all) AS id FROM toy_pairs)
         JOIN toy USING (id)""",
)
def c2(spark, sf):
    ids = views.toy_pairs(spark, sf).select("pair_id", F.posexplode("src_ids").alias("pos", "id"))
    learned = views.toy_vocabulary(spark, sf).vocab.filter("id > 3")
    return V.id_to_token(ids, learned).select("pair_id", "pos", "token")


@check(
    "h4_decode",
    with_views(*_TOY)
    + """SELECT pair_id, array_to_string([r[x] for x in tgt_all if x>3], ' ') AS text,
                array_to_string([coalesce(r[x], CASE x WHEN 1 THEN '[UNK]' WHEN 2 THEN '[SOS]' ELSE '[EOS]' END) for x in tgt_all], ' ') AS full_text
         FROM toy_pairs, (SELECT map(list(id), list(token)) AS r FROM toy)""",
)
def h4(spark, sf):
    tokens = views.toy_vocabulary(spark, sf).tokens()
    return views.toy_pairs(spark, sf).select(
        "pair_id",
        codec.decode(F.col("tgt_ids"), tokens).alias("text"),
        codec.decode(F.col("tgt_ids"), tokens, skip_special=False).alias("full_text"),
    )


@check(
    "d9_pair_token_counts",
    with_views(*_TOY) + "SELECT pair_id, len(src_all)::INTEGER AS src_tokens, len(tgt_all)::INTEGER AS tgt_tokens FROM toy_pairs",
)
def d9(spark, sf):
    return lengths.pair_token_counts(views.toy_pairs(spark, sf))


# ---- lengths of all document lines ---------------------------------------------------------


def line_lengths(spark: SparkSession, sf: str) -> DataFrame:
    source = views.lines(spark, sf)
    vocabulary = V.character_vocabulary(V.word_counts(source))
    encoded = codec.encode(source, vocabulary, {"line": "ids"})
    return encoded.select("doc_id", "line_no", F.size("ids").alias("n_tokens"))


_STATS = """SELECT round(avg(n_tokens),6) AS mean_len, round(quantile_cont(n_tokens,0.5),6) AS median_len,
                   round(quantile_cont(n_tokens,0.95),6) AS p95_len, max(n_tokens) AS max_len FROM """


def _rounded_stats(stats: DataFrame) -> DataFrame:
    return stats.select(*[six(c).alias(c) for c in ("mean_len", "median_len", "p95_len")], "max_len")


@check("d6_token_length_stats", with_views("lines", "line_lengths") + _STATS + "line_lengths")
def d6(spark, sf):
    return _rounded_stats(lengths.token_length_stats(line_lengths(spark, sf)))


@check(
    "d6_token_length_sample",
    with_views("lines", "line_lengths")
    + _STATS + "(SELECT n_tokens FROM line_lengths ORDER BY doc_id, line_no LIMIT 10000)",
)
def d6_sample(spark, sf):
    # A sampling operator: the report over the first 10,000 lines.
    return _rounded_stats(
        lengths.token_length_stats(lengths.first_lines(line_lengths(spark, sf), ["doc_id", "line_no"], 10_000))
    )


@check(
    "d7_token_length_histogram",
    with_views("lines", "line_lengths", more={
        "b": "SELECT min(n_tokens)::DOUBLE AS lo, max(n_tokens)::DOUBLE AS hi FROM line_lengths",
        "h": """SELECT least(floor((n_tokens-lo)/(hi-lo)*40),39)::BIGINT AS bin, count(*) AS n
                FROM line_lengths, b GROUP BY 1""",
    })
    + """SELECT r.bin, round(lo+r.bin*((hi-lo)/40),6) AS lo, round(lo+(r.bin+1)*((hi-lo)/40),6) AS hi, coalesce(n,0) AS n
         FROM (SELECT unnest(range(40)) AS bin) r LEFT JOIN h USING (bin), b""",
)
def d7(spark, sf):
    hist = lengths.token_length_histogram(line_lengths(spark, sf))
    return hist.select("bin", six("lo").alias("lo"), six("hi").alias("hi"), "n")


@check(
    "d8_over_max_len_share",
    with_views("lines", "line_lengths") + "SELECT round(avg((n_tokens>128)::INTEGER),6) AS over_share FROM line_lengths",
)
def d8(spark, sf):
    return lengths.over_max_len_share(line_lengths(spark, sf)).select(six("over_share").alias("over_share"))


# ---- streaming and user functions ------------------------------------------------------------


@check(
    "i1_stream_map_lines",
    with_views("lines")
    + f"""SELECT line, array_to_string({sql_words('line')}, ' ') AS words
          FROM (SELECT {sql_strip('line')} AS line FROM lines) WHERE length(line)>0""",
)
def i1(spark, sf):
    source, sink, state = (new_path(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    table(spark, sf, "documents").select("text").write.text(source)

    def words(batch: DataFrame) -> DataFrame:
        return batch.select("line", F.array_join(pre_tokenize(normalize(F.col("line"))), " ").alias("words"))

    stream_map_lines(spark, source, sink, state, words).awaitTermination()
    return spark.read.parquet(sink).select("line", "words")


@check(
    "j1_map_lines",
    with_views("lines", more={
        "numbered": f"SELECT row_number() OVER (ORDER BY doc_id, line_no) AS line_no, {sql_strip('line')} AS line FROM lines",
    })
    + "SELECT line_no, array_to_string(list_reverse(string_split(line, ' ')), ' ') AS text FROM numbered",
)
def j1(spark, sf):
    numbered = views.numbered(views.lines(spark, sf).withColumnRenamed("line_no", "at_line"), ["doc_id", "at_line"])
    return map_lines(numbered, lambda line: " ".join(reversed(line.split(" "))))
