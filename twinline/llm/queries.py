"""The registered queries of this package, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.stages import new_path, write_stage
from . import (
    bpe, decontaminate, hard_negatives, html_blocks, language_id, line_dedup, merkle, minhash_dedup, quality_model, quality_rules,
    sharding, simhash_dedup, substring_dedup,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(query):
        QUERIES[name] = query
        if sql is not None:
            SQL[name] = sql
        return query

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary() -> str:
    """Path of the byte-level vocabulary file that the encoding query is given."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op1_substring_dedup")
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage that an earlier document holds too."""
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


LINE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                  generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
s AS (SELECT doc_id, line_no, line,
             list_sort(list_distinct(list_filter(string_split_regex(line, '[ \x09-\x0D]+'), lambda x: x <> ''))) AS st FROM l),
c AS (SELECT row_number() OVER (ORDER BY st) AS id, st, len(st) AS n, min(row(doc_id, line_no)) AS at FROM s WHERE len(st) > 0 GROUP BY st),
t AS (SELECT id, n, unnest(st) AS w FROM c WHERE n >= 4),
f AS (SELECT w, count(*) AS df FROM t GROUP BY w),
p AS (SELECT id, n, w FROM (SELECT t.id, t.n, t.w, row_number() OVER (PARTITION BY t.id ORDER BY f.df, t.w) AS k FROM t JOIN f USING (w))
      WHERE k <= n - ((n * 4 + 4) // 5) + 1),
pairs AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n),
later AS (SELECT DISTINCT CASE WHEN ca.at > cb.at THEN ca.id ELSE cb.id END AS id
          FROM pairs JOIN c ca ON ca.id = pairs.a JOIN c cb ON cb.id = pairs.b
          WHERE 9 * len(list_intersect(ca.st, cb.st)) >= 4 * (ca.n + cb.n)),
v AS (SELECT s.doc_id, s.line_no, s.line,
             coalesce(c.id IS NOT NULL AND (later.id IS NOT NULL OR row(s.doc_id, s.line_no) > c.at), false) AS gone
      FROM s LEFT JOIN c ON s.st = c.st LEFT JOIN later ON later.id = c.id)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS text,
       count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed
FROM v GROUP BY doc_id
UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL
"""


@register("op2_line_dedup", LINE_SQL)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that repeat an earlier line of the table."""
    return line_dedup.remove_later_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


@register("op3_minhash_near_dedup")
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near copies."""
    return minhash_dedup.near_duplicate_classes(read(spark, sf_dir, "documents")).select(
        "doc_id", "class_id", "n_shingles", "kept"
    )


@register("op4_quality_model")
def op4_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the probability that it is of good quality."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.score_quality(docs, read(spark, sf_dir, "labels"))
    return scored.select(
        "doc_id", language_id.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


RULES_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^ \x09-\x0D]')) AS lines FROM t),
win AS (SELECT k, s, array_to_string(w[s + 1 : s + 5], ' ') AS win FROM w, unnest(range(0, len(w) - 4)) AS u(s) WHERE len(w) >= 5),
twice AS (SELECT k, win FROM win GROUP BY k, win HAVING count(*) >= 2),
rep AS (SELECT k, count(DISTINCT p) AS n FROM win SEMI JOIN twice USING (k, win), unnest(range(s, s + 5)) AS u(p) GROUP BY k),
b AS (SELECT w.k, doc_id, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words
      FROM w LEFT JOIN rep ON rep.k = w.k),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
h AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS bad FROM f GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS mean, var_pop(bad / n) AS var FROM h),
p AS (SELECT mean, CASE WHEN var > 1e-12 THEN greatest(1.0, mean * (1 - mean) / var - 1) ELSE 100.0 END AS strength FROM m),
v AS (SELECT source, (bad + strength * mean) / (n + strength) AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 6) AS host_rate,
       NOT base_failed AND NOT rate > 0.5 AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""


@register("op5_quality_rules", RULES_SQL)
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its base counts and the verdict of the rules and of its host."""
    return quality_rules.judge(read(spark, sf_dir, "documents"))


@register("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded; digests of both."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(bpe.encode_texts(docs, vocabulary()), "doc_id")


_W = r"list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

WINDOW_SQL = f"""
WITH d AS (SELECT doc_id, {_W} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 10) AS n FROM (SELECT item_id, {_W} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM i, unnest(range(0, len(w) - n + 1)) AS t(s)),
sizes AS (SELECT DISTINCT n FROM win),
dn AS (SELECT doc_id, w, n FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win FROM dn, unnest(range(0, len(w) - n + 1)) AS t(s)),
hit AS (SELECT doc_id, n, s, win FROM dw SEMI JOIN win USING (n, win)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
        FROM hit JOIN win USING (n, win) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@register("op7_decontamination", WINDOW_SQL)
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the benchmark windows it contains."""
    marked = decontaminate.mark_contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", decontaminate.count_words(F.col("text")).alias("n_words"), "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated",
    )


@register("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language."""
    named = language_id.identify_languages(read(spark, sf_dir, "documents"))
    return named.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


@register("op9_sharding")
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its place in 24 shards of equal counts, as the rewritten files hold it."""
    docs = read(spark, sf_dir, "documents")
    placed, _ = write_stage(sharding.reshard(docs), "placed")
    path = new_path(spark, "shards")
    sharding.rewrite_affected(docs, placed, path)
    return sharding.after_rewrite(docs, placed, path).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "moved",
    )


@register("op10_html_extraction")
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    pages = read(spark, sf_dir, "pages")
    return html_blocks.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@register("op11_simhash")
def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of its near copies."""
    return simhash_dedup.simhash_components(read(spark, sf_dir, "documents"))


NEGATIVES_SQL = """
WITH v AS (SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.k AS ak, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, a.k = b.k AS itself,
             list_inner_product(a.e, b.e)::BIGINT AS score
      FROM v a JOIN v b ON len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0),
p AS (SELECT ak, anchor_id, id AS positive_id, score AS ps, row_number() OVER (PARTITION BY ak ORDER BY score DESC, id) AS pk
      FROM s WHERE same AND NOT itself QUALIFY pk <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.ak, pk ORDER BY score DESC, id) AS rank,
       id AS negative_id, ps AS positive_score, score AS negative_score
FROM p JOIN s ON s.ak = p.ak AND NOT same AND 50 * ps <= 100 * score AND 100 * score <= 95 * ps
QUALIFY rank <= 3
"""


@register("op12_hard_negatives", NEGATIVES_SQL)
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor and positive with the best-scoring rows of other labels below the positive."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings").withColumn("label", label), "id % 50 = 0")


def _leaf_sql(text: str) -> str:
    values = ["doc_id", "source", "lang", "n_chars", text]
    framed = [f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values]
    return f"sha256({' || '.join(framed)})"


def _climb_sql(name: str, leaves: str) -> str:
    """Recursive tables ``<name>_nodes`` (all levels) and ``<name>_walk`` (each leaf climbing) over ``leaves(k, g, idx, total, h, f)``."""
    return f"""
{name}_nodes AS (
  SELECT g, 0 AS lvl, idx, total, h FROM {leaves}
  UNION ALL
  SELECT g, lvl + 1, idx // 8, (total + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM {name}_nodes WHERE total > 1
  GROUP BY g, lvl, idx // 8, total),
{name}_sib AS (
  SELECT g, lvl, idx, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
         coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM {name}_nodes WHERE total > 1 WINDOW w AS (PARTITION BY g, lvl, idx // 8 ORDER BY idx)),
{name}_walk AS (
  SELECT k, g, 0 AS lvl, idx, total, f, '' AS proof FROM {leaves}
  UNION ALL
  SELECT k, w.g, w.lvl + 1, w.idx // 8, (total + 7) // 8, sha256(bef || f || aft), proof || bef || aft
  FROM {name}_walk w JOIN {name}_sib s ON s.g IS NOT DISTINCT FROM w.g AND s.lvl = w.lvl AND s.idx = w.idx WHERE total > 1)"""


_CRC_BYTE = "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(s, b))"
_CRC32 = f"xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda s, b: {_CRC_BYTE}, 4294967295::BIGINT), 4294967295)"

#: crc32 has no SQL function, so it is stated bit by bit; a decimal number is ASCII.
MERKLE_SQL = f"""
WITH RECURSIVE t AS (
  SELECT row_number() OVER () AS k, doc_id, lang AS g, {_leaf_sql('text')} AS h,
         CASE WHEN {_CRC32} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
              ELSE {_leaf_sql('text')} END AS f FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS idx, count(*) OVER (PARTITION BY g) AS total FROM t),
{_climb_sql('low', 'l')},
r AS (SELECT g AS k, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS idx, count(*) OVER () AS total, h, h AS f
      FROM low_nodes WHERE total = 1),
{_climb_sql('high', 'r')},
mid AS (SELECT w.k, w.g, w.f, w.proof, r.h AS subroot, r.idx, r.total FROM low_walk w JOIN r ON r.k IS NOT DISTINCT FROM w.g WHERE w.total = 1),
up AS (
  SELECT k, 0 AS lvl, idx, total, f, proof, subroot FROM mid
  UNION ALL
  SELECT k, u.lvl + 1, u.idx // 8, (total + 7) // 8, sha256(bef || f || aft), proof || bef || aft, subroot
  FROM up u JOIN high_sib s ON s.lvl = u.lvl AND s.idx = u.idx WHERE total > 1)
SELECT l.doc_id, l.h AS leaf, up.subroot, root.h AS root, sha256(up.proof) AS proof_sha256, up.f AS folded_root, up.f = root.h AS verified
FROM up JOIN l ON l.k = up.k, (SELECT h FROM high_nodes WHERE total = 1) root WHERE up.total = 1
"""


@register("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its leaf, roots, proof, and whether it still verifies where a third were altered."""
    tampered = merkle.lowered_for_a_third(F.col("text"), F.col("doc_id"))
    return merkle.manifest(read(spark, sf_dir, "documents"), tampered)
