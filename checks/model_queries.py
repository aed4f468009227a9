"""Batches, scores, search, BLEU and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from twinline import workflow
from twinline.functions import ids as I, scores as S
from twinline.functions.text import bleu_tokenize_13a
from twinline.operators import batching as B, bleu, runlog as R, search
from twinline.plans.row_index import with_row_index
from twinline.plans.stages import new_path
from twinline.streaming.runlog import latest_loss, stream_running_loss

from . import views
from .registry import check
from .views import PAIRS_TO_SIDES, TRANSITIONS, joined, six, sql_join, table, with_views

SEED, BATCH = 7, 16


def _padded(spark: SparkSession, sf: str) -> DataFrame:
    pairs = views.toy_pairs(spark, sf, 128)
    return B.pad_batch(B.assign_batches(pairs, BATCH, SEED, lengths_of=("src_ids", "tgt_ids")))


def _sides(spark: SparkSession, sf: str) -> DataFrame:
    return B.with_decoder_sides(_padded(spark, sf))


# ---- batches -----------------------------------------------------------------------------


@check(
    "e1_assign_batches",
    with_views(*PAIRS_TO_SIDES[:6]) + "SELECT split, batch_id, pos, pair_id FROM placed",
)
def e1(spark, sf):
    return B.assign_batches(views.pairs(spark, sf), BATCH, SEED).select("split", "batch_id", "pos", "pair_id")


@check(
    "e2_pad_batch",
    with_views(*PAIRS_TO_SIDES[:7])
    + f"SELECT split, batch_id, pos, {sql_join('src_ids')} AS src_ids, {sql_join('tgt_ids')} AS tgt_ids FROM padded",
)
def e2(spark, sf):
    return _padded(spark, sf).select(
        "split", "batch_id", "pos", joined("src_ids").alias("src_ids"), joined("tgt_ids").alias("tgt_ids")
    )


@check(
    "b8_teacher_forcing_shift",
    with_views(*PAIRS_TO_SIDES)
    + f"SELECT split, batch_id, pos, {sql_join('tgt_in')} AS tgt_in, {sql_join('tgt_out')} AS tgt_out FROM sides",
)
def b8(spark, sf):
    return _sides(spark, sf).select(
        "split", "batch_id", "pos", joined("tgt_in").alias("tgt_in"), joined("tgt_out").alias("tgt_out")
    )


@check(
    "e3_source_mask",
    with_views(*PAIRS_TO_SIDES)
    + "SELECT split, batch_id, pos, array_to_string([(x=0)::INTEGER for x in src_ids], '') AS src_mask FROM sides",
)
def e3(spark, sf):
    bits = F.array_join(F.transform("src_mask", lambda b: b.cast("int").cast("string")), "")
    return B.with_masks(_sides(spark, sf)).select("split", "batch_id", "pos", bits.alias("src_mask"))


@check(
    "e4_target_mask",
    with_views(*PAIRS_TO_SIDES)
    + """SELECT split, batch_id, pos,
                array_to_string([array_to_string([(j>i OR tgt_in[j]=0)::INTEGER for j in range(1,len(tgt_in)+1)], '') for i in range(1,len(tgt_in)+1)], '|') AS tgt_mask
         FROM sides""",
)
def e4(spark, sf):
    bits = F.array_join(
        F.transform("tgt_mask", lambda row: F.array_join(F.transform(row, lambda b: b.cast("int").cast("string")), "")), "|"
    )
    return B.build_batches(views.toy_pairs(spark, sf, 128), BATCH, SEED).select(
        "split", "batch_id", "pos", bits.alias("tgt_mask")
    )


@check(
    "d11_batch_token_count",
    with_views(*PAIRS_TO_SIDES)
    + """SELECT split, batch_id, CAST(sum(len([x for x in tgt_out if x<>0])) AS BIGINT) AS n_tokens
         FROM sides GROUP BY split, batch_id""",
)
def d11(spark, sf):
    return B.batch_token_count(_sides(spark, sf))


# ---- BLEU ----------------------------------------------------------------------------------

_S = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _sql_13a(text: str) -> str:
    for old, new in (("'<skipped>'", "''"), ("concat('-',chr(10))", "''"), ("chr(10)", "' '"),
                     ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"), ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        text = f"replace({text}, {old}, {new})"
    text = f"concat(' ', {text}, ' ')"
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "),
                         (r"([\.,])([^0-9])", r" \1 \2"), (r"([0-9])(-)", r"\1 \2 ")):
        text = f"regexp_replace({text}, '{pattern}', '{new}', 'g')"
    return f"[t for t in string_split_regex({text}, '{_S}') if t<>'']"


_GRAMS = {
    "m_cut": f"SELECT sent_id, {_sql_13a('hyp')} AS h, {_sql_13a('ref')} AS r FROM scored",
    "hg": """SELECT sent_id, k AS n, gram, count(*) AS c FROM (
               SELECT sent_id, k, unnest([array_to_string(h[i:i+k-1],' ') for i in range(1, len(h)-k+2)]) AS gram
               FROM m_cut, (VALUES (1),(2),(3),(4)) o(k)) GROUP BY ALL""",
    "rg": """SELECT sent_id, k AS n, gram, count(*) AS c FROM (
               SELECT sent_id, k, unnest([array_to_string(r[i:i+k-1],' ') for i in range(1, len(r)-k+2)]) AS gram
               FROM m_cut, (VALUES (1),(2),(3),(4)) o(k)) GROUP BY ALL""",
    "stats": """SELECT n, CAST(coalesce((SELECT sum(least(hg.c, rg.c)) FROM hg JOIN rg USING (sent_id, n, gram) WHERE n=o.n),0) AS BIGINT) AS correct,
                       CAST((SELECT sum(c) FROM hg WHERE n=o.n) AS BIGINT) AS total,
                       CAST((SELECT sum(c) FROM rg WHERE n=o.n) AS BIGINT) AS ref_total
                FROM (VALUES (1),(2),(3),(4)) o(n)""",
    "lens": """SELECT sum(total) FILTER (n=1) AS sys_len, sum(ref_total) FILTER (n=1) AS ref_len,
                      sum(ln(100.0*correct/total)) AS logs FROM stats""",
    "score": """SELECT round(CASE WHEN sys_len>=ref_len THEN 1.0 ELSE exp(1-ref_len/sys_len) END * exp(logs/4),6) AS bleu,
                       CAST(sys_len AS BIGINT) AS sys_len, CAST(ref_len AS BIGINT) AS ref_len FROM lens""",
}
_ALL_SCORED = {"scored": "SELECT * FROM hyp_ref", **_GRAMS}
_FIRST_SCORED = {
    "scored": "SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (ORDER BY sent_id)-1 AS i FROM hyp_ref) WHERE i//8 < 20",
    **_GRAMS,
}


@check(
    "h10_bleu_tokenize_13a",
    with_views("lines") + f"SELECT doc_id, line_no, array_to_string({_sql_13a('line')}, ' ') AS tokens FROM lines",
)
def h10(spark, sf):
    return views.lines(spark, sf).select(
        "doc_id", "line_no", F.array_join(bleu_tokenize_13a(F.col("line")), " ").alias("tokens")
    )


@check("c3_align_hyp_ref", with_views("pairs", "hyp_ref") + "SELECT sent_id, hyp, ref FROM hyp_ref")
def c3(spark, sf):
    return bleu.align_hyp_ref(views.hyps(spark, sf), views.refs(spark, sf))


@check(
    "c3_missing_hypotheses",
    with_views("pairs", "hyp_ref") + "SELECT sent_id, CASE WHEN sent_id%11=0 THEN '' ELSE hyp END AS hyp, ref FROM hyp_ref",
)
def c3_missing(spark, sf):
    return bleu.align_hyp_ref(views.hyps(spark, sf).filter("sent_id % 11 <> 0"), views.refs(spark, sf))


@check("d14_bleu_ngram_stats", with_views("pairs", "hyp_ref", more=_ALL_SCORED) + "SELECT n, correct, total, ref_total FROM stats")
def d14(spark, sf):
    return bleu.bleu_ngram_stats(bleu.align_hyp_ref(views.hyps(spark, sf), views.refs(spark, sf)))


def _score(df: DataFrame) -> DataFrame:
    return df.select(six("bleu").alias("bleu"), "sys_len", "ref_len")


@check("d15_corpus_bleu", with_views("pairs", "hyp_ref", more=_ALL_SCORED) + "SELECT * FROM score")
def d15(spark, sf):
    return _score(bleu.corpus_bleu(bleu.align_hyp_ref(views.hyps(spark, sf), views.refs(spark, sf))))


@check("d16_corpus_bleu_capped", with_views("pairs", "hyp_ref", more=_FIRST_SCORED) + "SELECT * FROM score")
def d16(spark, sf):
    # Scoring the first 20 batches is the operator itself.
    numbered = with_row_index(views.hyp_ref(spark, sf), ["sent_id"], out="i")
    batched = numbered.withColumn("batch_id", F.floor(F.col("i") / 8))
    return _score(bleu.corpus_bleu_capped(batched, 20))


# ---- text to text: a stand-in model whose scores, by sentence and step, copy the source ------------

WIDTH, MAX_LEN, ALPHA = 3, 6, 0.6
COPIED = 16


def _copy_scores(encoded: DataFrame) -> DataFrame:
    """At each step the next source id, and the unknown token far behind."""
    pairs = F.arrays_zip(F.col("src_ids").alias("prev_id"), F.slice("src_ids", F.lit(2), F.size("src_ids")).alias("next_id"))
    steps = encoded.select("sent_id", F.posexplode(pairs).alias("step", "p")).select("sent_id", "step", "p.*").filter("next_id IS NOT NULL")
    return steps.withColumn("logp", F.lit(-0.1)).unionByName(steps.select("sent_id", "step", "prev_id", F.lit(1).alias("next_id"), F.lit(-5.0).alias("logp")))


_COPIES = {
    "names": "SELECT map(list(id), list(token)) AS d FROM toy",
    "said": f"""SELECT pair_id, split, src_all[2:len(src_all)-1] AS ids, tgt_all, least(len(src_all)-1, {COPIED}) AS steps FROM toy_pairs""",
}


@check(
    "w1_translate_lines",
    with_views("pairs", "toy", "toy_map", "toy_pairs", more=_COPIES)
    + f"""SELECT pair_id AS line_no, 1 AS rank, array_to_string([d[x] for x in ids[1:{COPIED}] if x>3], ' ') AS text,
                 round(-0.1*steps/pow((5+steps+1)/6.0, {ALPHA}), 6) AS lp_score FROM said, names""",
)
def w1(spark, sf):
    lines = views.pairs(spark, sf).select(F.col("pair_id").alias("line_no"), F.col("src").alias("line"))
    found = workflow.translate_lines(lines, views.toy_vocabulary(spark, sf), _copy_scores, WIDTH, COPIED, ALPHA)
    return found.withColumn("lp_score", six("lp_score"))


@check(
    "w2_evaluate_split",
    with_views("pairs", "toy", "toy_map", "toy_pairs", more=_COPIES | {
        "scored": f"""SELECT pair_id AS sent_id, array_to_string([d[x] for x in ids[1:{COPIED-1}] if x>3], ' ') AS hyp,
                             array_to_string([d[x] for x in tgt_all if x>3], ' ') AS ref FROM said, names WHERE split='test'""",
    } | _GRAMS)
    + "SELECT * FROM score",
)
def w2(spark, sf):
    return _score(workflow.evaluate_split(views.pairs(spark, sf), views.toy_vocabulary(spark, sf), _copy_scores, max_len=COPIED))


# ---- scores over stored model outputs ---------------------------------------------------------

_LSE = {"n": "SELECT *, list_max(logits)+ln(list_sum([exp(x-list_max(logits)) for x in logits])) AS lse FROM logits"}


@check("f1_greedy_argmax", with_views("logits") + "SELECT vec_id, CAST(list_position(logits, list_max(logits))-1 AS INTEGER) AS best_id FROM logits")
def f1(spark, sf):
    return views.logits(spark, sf).select("vec_id", S.argmax_id(F.col("logits")).alias("best_id"))


@check(
    "h7_log_softmax",
    with_views("logits", more=_LSE)
    + """SELECT vec_id, i::INTEGER-1 AS id, round(x-lse,6) AS log_prob, round(exp(x-lse),6) AS prob
         FROM (SELECT vec_id, lse, generate_subscripts(logits,1) AS i, unnest(logits) AS x FROM n)""",
)
def h7(spark, sf):
    both = F.arrays_zip(S.log_softmax(F.col("logits")).alias("a"), S.softmax(F.col("logits")).alias("b"))
    rows = views.logits(spark, sf).select("vec_id", F.posexplode(both).alias("id", "p"))
    return rows.select("vec_id", "id", six("p.a").alias("log_prob"), six("p.b").alias("prob"))


_LOSS = {
    **_LSE,
    "l": """SELECT vec_id, target, CASE WHEN target=0 THEN 0 ELSE
                -list_sum([CASE WHEN i-1=target THEN 0.9 WHEN i=1 THEN 0 ELSE 0.1/62 END * (logits[i]-lse) for i in range(1,65)]) END AS loss FROM n""",
}


@check("h9_position_loss", with_views("logits", more=_LOSS) + "SELECT vec_id, round(loss,6) AS loss FROM l")
def h9(spark, sf):
    return views.logits(spark, sf).select("vec_id", six(S.position_loss(F.col("logits"), F.col("target"))).alias("loss"))


@check(
    "h9_label_smoothed_loss",
    with_views("logits", more=_LOSS)
    + "SELECT round(sum(loss)/greatest(count(*) FILTER (target<>0),1),6) AS loss FROM l",
)
def h9_mean(spark, sf):
    loss = F.sum(S.position_loss(F.col("logits"), F.col("target")))
    real = F.greatest(F.count_if(F.col("target") != 0), F.lit(1))
    return views.logits(spark, sf).agg(F.round(loss / real, 6).alias("loss"))


# ---- search ------------------------------------------------------------------------------------

@check(
    "f2_topk_tokens",
    with_views(*TRANSITIONS)
    + """SELECT prev_id, next_id, logp, token_rank FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY prev_id ORDER BY logp DESC, next_id) AS INTEGER) AS token_rank FROM transitions)
         WHERE token_rank<=3""",
)
def f2(spark, sf):
    return search.topk_tokens(views.transitions(spark, sf), ["prev_id"], WIDTH)


@check(
    "f4_min_len_mask",
    with_views(*TRANSITIONS)
    + """SELECT prev_id, next_id, logp, token_rank FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY prev_id ORDER BY logp DESC, next_id) AS INTEGER) AS token_rank
            FROM transitions WHERE next_id<>3)
         WHERE token_rank<=3""",
)
def f4(spark, sf):
    return search.topk_tokens(search.ban_eos(views.transitions(spark, sf), 0, 1), ["prev_id"], WIDTH)


def _beam(spark: SparkSession, sf: str) -> DataFrame:
    return views.starts(spark, sf).select(
        "sent_id", F.lit(0).alias("hyp_id"), "ids", F.lit(0.0).alias("score"), F.lit(False).alias("done")
    )


_EXPANDED = {
    "expanded": """SELECT sent_id, next_id, logp AS score, list_append(ids, next_id) AS ids, next_id=3 AS done
                   FROM starts JOIN transitions ON prev_id=ids[2]""",
}


@check(
    "c4_expand_beam",
    with_views(*TRANSITIONS, more=_EXPANDED)
    + f"SELECT sent_id, next_id, score, {sql_join('ids')} AS ids, done::INTEGER AS done FROM expanded",
)
def c4(spark, sf):
    return search.expand_beam(_beam(spark, sf), views.transitions(spark, sf)).select(
        "sent_id", "next_id", "score", joined("ids").alias("ids"), F.col("done").cast("int").alias("done")
    )


@check(
    "f3_prune_beam",
    with_views(*TRANSITIONS, more=_EXPANDED)
    + f"""SELECT sent_id, {sql_join('ids')} AS ids, score, hyp_rank FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, next_id) AS INTEGER) AS hyp_rank FROM expanded WHERE NOT done)
          WHERE hyp_rank<=3""",
)
def f3(spark, sf):
    expanded = search.expand_beam(_beam(spark, sf), views.transitions(spark, sf))
    return search.prune_beam(expanded, WIDTH, ["next_id"]).select("sent_id", joined("ids").alias("ids"), "score", "hyp_rank")


@check(
    "f5_nbest_rank",
    with_views(*TRANSITIONS, more=_EXPANDED)
    + f"""SELECT sent_id, rank, {sql_join('ids')} AS ids, round(lp,6) AS lp_score FROM
           (SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY lp DESC, next_id) AS INTEGER) AS rank
            FROM (SELECT *, score/pow((5+len(ids))/6.0, 0.6) AS lp FROM expanded))
          WHERE rank<=2""",
)
def f5(spark, sf):
    expanded = search.expand_beam(_beam(spark, sf), views.transitions(spark, sf))
    return search.nbest_rank(expanded, ["next_id"], WIDTH, ALPHA, n_best=2).select(
        "sent_id", "rank", joined("ids").alias("ids"), six("lp_score").alias("lp_score")
    )


@check(
    "h8_length_penalised_score",
    with_views(*TRANSITIONS, more=_EXPANDED)
    + f"SELECT sent_id, {sql_join('ids')} AS ids, round(score/pow((5+len(ids))/6.0, 0.6),6) AS lp_score FROM expanded",
)
def h8(spark, sf):
    expanded = search.expand_beam(_beam(spark, sf), views.transitions(spark, sf))
    lp = S.length_penalised_score(F.col("score"), F.size("ids"), ALPHA)
    return expanded.select("sent_id", joined("ids").alias("ids"), six(lp).alias("lp_score"))


def _unrolled_beam(steps: int = MAX_LEN, by_sentence: bool = False) -> dict[str, str]:
    keys, scores = ("sent_id, step, prev_id", "sentence_scores") if by_sentence else ("prev_id", "transitions")
    own = lambda t: f" AND c.sent_id=l.sent_id AND c.step={t-1}" if by_sentence else ""
    ranked = f"SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY logp DESC, next_id) AS tr FROM {scores}"
    more = {
        "m_any": f"SELECT * FROM ({ranked}) WHERE tr<={WIDTH}",
        "m_early": f"SELECT * FROM ({ranked} WHERE next_id<>3) WHERE tr<={WIDTH}",
        "m_live0": "SELECT sent_id, ids, 0.0::DOUBLE AS score, 1 AS hr FROM starts",
        "m_done0": "SELECT sent_id, ids, 0.0::DOUBLE AS score, 0 AS step, 0 AS ord FROM starts WHERE false",
    }
    for t in range(1, steps + 1):
        near = "m_early" if t == 1 else "m_any"
        more[f"m_cand{t}"] = f"""
            SELECT l.sent_id, list_append(l.ids, c.next_id) AS ids, l.score+c.logp AS score, c.next_id=3 AS fin, l.hr*100+c.tr AS ord
            FROM m_live{t-1} l JOIN {near} c ON c.prev_id=l.ids[len(l.ids)]{own(t)}"""
        more[f"m_stuck{t}"] = f"""
            SELECT sent_id, ids, score, {t} AS step, hr AS ord FROM m_live{t-1} l
            WHERE NOT EXISTS (SELECT 1 FROM {near} c WHERE c.prev_id=l.ids[len(l.ids)]{own(t)})"""
        more[f"m_done{t}"] = f"""
            SELECT * FROM m_done{t-1} UNION ALL SELECT sent_id, ids, score, {t}, ord FROM m_cand{t} WHERE fin"""
        more[f"m_pruned{t}"] = f"""
            SELECT * FROM (SELECT sent_id, ids, score, row_number() OVER (PARTITION BY sent_id ORDER BY score DESC, ord) AS hr
                           FROM m_cand{t} WHERE NOT fin) WHERE hr<={WIDTH}"""
        more[f"m_full{t}"] = f"SELECT sent_id FROM m_done{t} GROUP BY sent_id HAVING count(*)>={WIDTH}"
        more[f"m_live{t}"] = f"SELECT * FROM m_pruned{t} WHERE sent_id NOT IN (SELECT sent_id FROM m_full{t})"
        more[f"m_left{t}"] = f"SELECT * FROM m_pruned{t} WHERE sent_id IN (SELECT sent_id FROM m_full{t})"
    left = " UNION ALL ".join(
        f"SELECT sent_id, ids, score, 99 AS step, hr AS ord FROM m_left{t} UNION ALL SELECT * FROM m_stuck{t}" for t in range(1, steps + 1)
    )
    more["m_all"] = f"""SELECT * FROM m_done{steps} UNION ALL {left}
                        UNION ALL SELECT sent_id, ids, score, 99, hr FROM m_live{steps}"""
    more["m_ranked"] = f"""
        SELECT *, CAST(row_number() OVER (PARTITION BY sent_id ORDER BY lp DESC, step, ord) AS INTEGER) AS rank
        FROM (SELECT *, score/pow((5+len(ids))/6.0, {ALPHA}) AS lp FROM m_all)"""
    more["beam_out"] = f"""
        SELECT sent_id, rank, array_to_string([x for x in ids[2:] if x<>3], ' ') AS ids, round(score,6) AS score, round(lp,6) AS lp_score
        FROM m_ranked WHERE rank<={WIDTH}"""
    return more


def _search(spark: SparkSession, sf: str, more: DataFrame | None = None) -> DataFrame:
    starts = views.starts(spark, sf)
    found = search.beam_search(
        starts if more is None else starts.unionByName(more), views.transitions(spark, sf), WIDTH, MAX_LEN, ALPHA
    )
    return found.select(
        "sent_id", "rank", joined("ids").alias("ids"), six("score").alias("score"), six("lp_score").alias("lp_score")
    )


_BEAM = with_views(*TRANSITIONS, more=_unrolled_beam())


@check("f6_beam_search", _BEAM + "SELECT sent_id, ids, score, lp_score FROM beam_out WHERE rank=1")
def f6(spark, sf):
    return _search(spark, sf).filter("rank = 1").drop("rank")


@check("f8_show_alternatives", _BEAM + "SELECT * FROM beam_out")
def f8(spark, sf):
    found = search.beam_hypotheses(views.starts(spark, sf), views.transitions(spark, sf), WIDTH, MAX_LEN)
    shown = search.show_alternatives(found, ["ended", "hyp_id"], WIDTH, ALPHA)
    return shown.select(
        "sent_id", "rank", joined(I.strip_special_ids(F.col("ids"))).alias("ids"), six("score").alias("score"), six("lp_score").alias("lp_score")
    )


@check(
    "f6_beam_search_by_sentence",
    with_views("kinds", "walk", "sentence_scores", "starts", more=_unrolled_beam(3, by_sentence=True)) + "SELECT * FROM beam_out",
)
def f6_by_sentence(spark, sf):
    found = search.beam_search(views.starts(spark, sf), views.sentence_scores(spark, sf), WIDTH, 3, ALPHA)
    return found.select(
        "sent_id", "rank", joined("ids").alias("ids"), six("score").alias("score"), six("lp_score").alias("lp_score")
    )


@check(
    "f6_beam_search_dead_ends",
    _BEAM + "SELECT * FROM beam_out UNION ALL SELECT -sent_id-1, 1, '1', 0.0, 0.0 FROM starts",
)
def f6_dead_ends(spark, sf):
    # The unknown token has no candidates: such a sentence stops at once and stays.
    stuck = views.starts(spark, sf).select((-F.col("sent_id") - 1).alias("sent_id"), F.array(F.lit(2), F.lit(1)).alias("ids"))
    return _search(spark, sf, stuck)


def _unrolled_greedy() -> dict[str, str]:
    more = {
        "m_top": "SELECT prev_id, next_id, logp FROM (SELECT *, row_number() OVER (PARTITION BY prev_id ORDER BY logp DESC, next_id) AS tr FROM transitions) WHERE tr=1",
        "m_g0": "SELECT sent_id, ids, 0.0::DOUBLE AS score FROM starts",
    }
    for t in range(1, 12):
        more[f"m_g{t}"] = f"""
            SELECT g.sent_id, CASE WHEN c.next_id IS NULL THEN g.ids ELSE list_append(g.ids, c.next_id) END AS ids, g.score+coalesce(c.logp,0) AS score
            FROM m_g{t-1} g LEFT JOIN m_top c ON c.prev_id=g.ids[len(g.ids)] AND g.ids[len(g.ids)]<>3"""
    return more


@check(
    "f7_greedy_decode",
    with_views(*TRANSITIONS, more=_unrolled_greedy())
    + "SELECT sent_id, array_to_string([x for x in ids[2:] if x<>3],' ') AS ids, round(score,6) AS score FROM m_g11",
)
def f7(spark, sf):
    found = search.greedy_decode(views.starts(spark, sf), views.transitions(spark, sf), max_len=12)
    return found.select("sent_id", joined("ids").alias("ids"), six("score").alias("score"))


# ---- run logs ------------------------------------------------------------------------------------


@check(
    "d12_token_weighted_loss",
    with_views("batch_log")
    + """SELECT epoch, round(sum(loss*n_tokens)/greatest(sum(n_tokens),1),6) AS mean_loss, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
         FROM batch_log GROUP BY epoch""",
)
def d12(spark, sf):
    return R.token_weighted_loss(views.batch_log(spark, sf)).select("epoch", six("mean_loss").alias("mean_loss"), "n_tokens")


@check("d13_perplexity", with_views("batch_log") + "SELECT epoch, batch_idx, round(exp(least(loss*100,20)),3) AS ppl FROM batch_log")
def d13(spark, sf):
    # The stored value itself is used as a loss here, so that the bound of 20 is met on both sides.
    return views.batch_log(spark, sf).select("epoch", "batch_idx", F.round(S.perplexity(F.col("loss") * 100), 3).alias("ppl"))


@check(
    "e6_accum_steps",
    with_views("batch_log")
    + """SELECT epoch, batch_idx, (((batch_idx+1)%4=0) OR batch_idx=max(batch_idx) OVER (PARTITION BY epoch))::INTEGER AS is_update,
                batch_idx//4+1 AS step FROM batch_log""",
)
def e6(spark, sf):
    return R.accum_steps(views.batch_log(spark, sf), 4).select(
        "epoch", "batch_idx", F.col("is_update").cast("int").alias("is_update"), "step"
    )


@check(
    "e7_running_loss_log",
    with_views("batch_log", more={
        "r": """SELECT epoch, batch_idx, elapsed_s, sum(loss*n_tokens) OVER w AS ls, sum(n_tokens) OVER w AS ts FROM batch_log
                WINDOW w AS (PARTITION BY epoch ORDER BY batch_idx)""",
    })
    + """SELECT epoch, batch_idx+1 AS batch_no, round(ls/greatest(ts,1),6) AS mean_loss,
                round(exp(least(ls/greatest(ts,1),20)),6) AS ppl, round(ts/elapsed_s,6) AS tok_per_s
         FROM r WHERE (batch_idx+1)%50=0""",
)
def e7(spark, sf):
    # Several parts, so that sums are carried from part to part even in a small log.
    log = R.running_loss_log(views.batch_log(spark, sf), 50, parts=16)
    return log.select("epoch", "batch_no", *[six(c).alias(c) for c in ("mean_loss", "ppl", "tok_per_s")])


_EPOCHS = ("batch_log", "epoch_loss", "epoch_log")


@check(
    "e8_best_checkpoints",
    with_views(*_EPOCHS)
    + """SELECT epoch, bleu AS best_bleu FROM
           (SELECT *, max(bleu) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM epoch_log)
         WHERE bleu > greatest(coalesce(p,0),0)""",
)
def e8(spark, sf):
    return R.best_checkpoints(views.epoch_log(spark, sf), parts=3)


@check(
    "e8_best_checkpoints_resumed",
    with_views(*_EPOCHS)
    + """SELECT epoch, bleu AS best_bleu FROM
           (SELECT *, max(bleu) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM epoch_log WHERE epoch>=6)
         WHERE bleu > greatest(coalesce(p,0),25)""",
)
def e8_resumed(spark, sf):
    return R.best_checkpoints(views.epoch_log(spark, sf), initial_best=25.0, start_epoch=6)


@check("e9_periodic_snapshots", with_views(*_EPOCHS) + "SELECT epoch, printf('epoch_%03d', epoch) AS name FROM epoch_log WHERE epoch%5=0")
def e9(spark, sf):
    return R.periodic_snapshots(views.epoch_log(spark, sf), 5)


@check("e10_generalization_gap", with_views(*_EPOCHS) + "SELECT epoch, round(val_loss-train_loss,6) AS gap FROM epoch_log WHERE val_loss>train_loss")
def e10(spark, sf):
    return R.generalization_gap(views.epoch_log(spark, sf)).select("epoch", six("gap").alias("gap"))


@check(
    "e11_decode_throughput",
    with_views("batch_log")
    + """SELECT epoch, item_no, round(item_no/elapsed_s,6) AS items_per_s FROM
           (SELECT *, batch_idx+1 AS item_no, max(batch_idx+1) OVER (PARTITION BY epoch) AS total FROM batch_log)
         WHERE (item_no%100=0 OR item_no=total) AND n_tokens<>0""",
)
def e11(spark, sf):
    log = views.batch_log(spark, sf).select(
        "epoch", (F.col("batch_idx") + 1).alias("item_no"), "elapsed_s", (F.col("n_tokens") == 0).alias("blank")
    )
    return R.decode_throughput(log, 100, ["epoch"]).select("epoch", "item_no", six("items_per_s").alias("items_per_s"))


_STEPS = {
    "per": "SELECT epoch, max(batch_idx)//4+1 AS k FROM batch_log GROUP BY epoch",
    "taken": """SELECT b.epoch, coalesce(sum(p.k),0)+b.step AS step FROM
                  (SELECT epoch, batch_idx//4+1 AS step FROM batch_log
                   QUALIFY (batch_idx+1)%4=0 OR batch_idx=max(batch_idx) OVER (PARTITION BY epoch)) b
                LEFT JOIN per p ON p.epoch<b.epoch GROUP BY b.epoch, b.step""",
    "curve": """SELECT epoch, CAST(step AS BIGINT) AS step,
                       512**(-0.5)*least(step::DOUBLE**(-0.5), step*1000::DOUBLE**(-1.5)) AS lr FROM taken""",
}


def _update_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The optimiser's step number over the whole run, one row per update."""
    updates = R.accum_steps(views.batch_log(spark, sf), 4).filter("is_update").select("epoch", "step")
    per_epoch = updates.groupBy("epoch").agg(F.count("*").alias("k"))
    before = R.with_running(per_epoch, [], "epoch", {"before": ("sum", F.col("k"))}, inclusive=False)
    return updates.join(before.select("epoch", "before"), "epoch").select(
        "epoch", (F.col("before") + F.col("step")).alias("step")
    )


@check("h5_noam_lr", with_views("batch_log", more=_STEPS) + "SELECT epoch, step, round(lr*1000000,6) AS lr_e6 FROM curve")
def h5(spark, sf):
    curve = R.lr_curve(_update_steps(spark, sf), d_model=512, warmup=1000)
    return curve.select("epoch", "step", six(F.col("lr") * 1_000_000).alias("lr_e6"))


@check(
    "h6_lr_peak",
    with_views("batch_log", more=_STEPS)
    + "SELECT step AS peak_step, round(lr*1000000,6) AS peak_lr_e6 FROM curve ORDER BY lr DESC, step LIMIT 1",
)
def h6(spark, sf):
    peak = R.lr_peak(R.lr_curve(_update_steps(spark, sf), d_model=512, warmup=1000))
    return peak.select("peak_step", six(F.col("peak_lr") * 1_000_000).alias("peak_lr_e6"))


@check(
    "h6_lr_by_epoch",
    with_views("batch_log", more=_STEPS)
    + "SELECT epoch, max(step) AS last_step, round(arg_max(lr, step)*1000000,6) AS lr_e6 FROM curve GROUP BY epoch",
)
def h6_epochs(spark, sf):
    curve = R.lr_curve(_update_steps(spark, sf), d_model=512, warmup=1000)
    return curve.groupBy("epoch").agg(
        F.max("step").alias("last_step"), six(F.max_by("lr", "step") * 1_000_000).alias("lr_e6")
    )


@check(
    "c5_interpolate",
    with_views("priced", "known", "grid", more={
        "ends": """SELECT g.series, g.x, l.x AS ax, l.y AS ay, r.x AS bx, r.y AS b_y
                   FROM grid g ASOF LEFT JOIN known l ON g.series=l.series AND g.x>=l.x
                   ASOF LEFT JOIN known r ON g.series=r.series AND g.x<=r.x""",
    })
    + """SELECT series, x::DOUBLE AS x, round(CASE WHEN ax IS NULL THEN b_y WHEN bx IS NULL OR ax=bx THEN ay
                ELSE ay+(b_y-ay)/(bx-ax)*(x-ax) END,6) AS y FROM ends""",
)
def c5(spark, sf):
    filled = R.interpolate(views.known(spark, sf), views.grid(spark, sf), ["series"], parts=16)
    return filled.select("series", "x", six("y").alias("y"))


# ---- streaming -----------------------------------------------------------------------------------


@check(
    "i2_stream_running_loss",
    with_views("batch_log")
    + """SELECT epoch, round(sum(loss*n_tokens)/greatest(sum(n_tokens),1),6) AS mean_loss, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
         FROM batch_log GROUP BY epoch""",
)
def i2(spark, sf):
    sink, state = new_path(spark, "loss-out"), new_path(spark, "loss-state")
    events = (
        spark.readStream.schema(table(spark, sf, "events").schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(sf)
    )
    stream_running_loss(views.batch_log_of(events), sink, state).awaitTermination()
    return latest_loss(spark, sink).select("epoch", six("mean_loss").alias("mean_loss"), "n_tokens")
