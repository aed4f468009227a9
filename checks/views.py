"""Inputs of the queries, derived from the given tables: once for Spark, once as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from twinline.functions.text import EXTRA_LINE_BREAKS, split_physical_lines
from twinline.operators.codec import encode
from twinline.operators.vocab import Vocabulary, character_vocabulary, word_counts
from twinline.plans.row_index import with_row_index
from twinline.plans.sizing import spread

RE2_WORDS = (
    r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}]+"
    r"|[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200c}\x{200d}\s\x{a0}]+"
)
RE2_SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
RE2_BREAK = r"\r\n|\r|\n|[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def joined(ids: Column | str) -> Column:
    """An id array as text, so that both engines hash it alike."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    return F.array_join(ids.cast("array<string>"), " ")


def six(value: Column | str) -> Column:
    return F.round(value, 6)


# ---- SQL helpers -----------------------------------------------------------------------


def sql_words(text: str) -> str:
    return f"regexp_extract_all(lower(replace({text}, 'Σ', 'σ')), '{RE2_WORDS}')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{RE2_SPACE}+|{RE2_SPACE}+$', '', 'g')"


def sql_join(ids: str) -> str:
    return f"array_to_string({ids}, ' ')"


#: Line pairs of a document are numbered below this.
DOC_LINES = 1_000_000

CTES = {
    "pairs": """
        SELECT u.conv_id*1000+u.turn AS pair_id,
               CASE WHEN u.conv_id%10<8 THEN 'train' WHEN u.conv_id%10=8 THEN 'validation' ELSE 'test' END AS split,
               u.text AS src, a.text AS tgt
        FROM conversations u JOIN conversations a ON a.conv_id=u.conv_id AND a.turn=u.turn+1
        WHERE u.role='user' AND a.role='assistant'""",
    "extra": f"""
        SELECT doc_id*{DOC_LINES}+k AS pair_id, 'train' AS split,
               {sql_strip("l[2*k+1]")} AS src, {sql_strip("coalesce(l[2*k+2],'')")} AS tgt
        FROM (SELECT doc_id, l, unnest(range((len(l)+1)//2)) AS k
              FROM (SELECT doc_id, string_split(text,chr(10)) AS l FROM documents))""",
    "kept_extra": "SELECT * FROM extra WHERE length(src)>0 AND length(tgt)>0",
    "merged": "SELECT *, 'base' AS origin FROM pairs UNION ALL SELECT *, 'extra' AS origin FROM kept_extra",
    "lines": r"""
        SELECT doc_id, generate_subscripts(l, 1) AS line_no, unnest(l) AS line
        FROM (SELECT doc_id, string_split_regex(text, '\r\n|\r|\n') AS l FROM documents)""",
    "hyp_ref": """
        SELECT pair_id AS sent_id,
               array_to_string(list_filter(string_split(tgt,' '), lambda w, i: (i-1)%7<>3), ' ') AS hyp,
               tgt AS ref
        FROM pairs""",
    "batch_log": """
        SELECT event_id//500+1 AS epoch, event_id%500 AS batch_idx, value/100 AS loss,
               CAST(json_extract(props,'$.k') AS BIGINT) AS n_tokens, (event_id%500+1)*0.1::DOUBLE AS elapsed_s
        FROM events""",
    "epoch_loss": """
        SELECT epoch, batch_idx%2 AS side, sum(loss*n_tokens)/greatest(sum(n_tokens),1) AS l
        FROM batch_log GROUP BY ALL""",
    "epoch_log": """
        SELECT a.epoch, a.l AS train_loss, b.l AS val_loss, round(20+a.epoch-20*a.l,4) AS bleu
        FROM epoch_loss a JOIN epoch_loss b ON a.epoch=b.epoch AND a.side=0 AND b.side=1""",
    "logits": "SELECT vec_id, [x::DOUBLE for x in embedding] AS logits, label AS target FROM embeddings",
    "priced": """
        SELECT o_orderpriority AS series, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS x,
               o_orderstatus AS status, o_totalprice AS price
        FROM orders""",
    "known": "SELECT series, x, max(price) AS y FROM priced WHERE status='F' GROUP BY ALL",
    "grid": "SELECT DISTINCT series, x FROM priced",
    "kinds": """
        SELECT event_type, CAST(3+row_number() OVER (ORDER BY event_type) AS INTEGER) AS id
        FROM (SELECT DISTINCT event_type FROM events)""",
    "walk": """
        SELECT user_id, event_id, k.id, lead(k.id) OVER w AS next_id, row_number() OVER w AS place
        FROM events JOIN kinds k USING (event_type)
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "steps": """
        SELECT id AS prev_id, coalesce(next_id,3) AS next_id FROM walk
        UNION ALL SELECT 2, id FROM walk WHERE place=1""",
    "transitions": """
        SELECT prev_id, next_id, round(ln(n/sum(n) OVER (PARTITION BY prev_id)),9) AS logp
        FROM (SELECT prev_id, next_id, count(*)::DOUBLE AS n FROM steps GROUP BY ALL)""",
    "starts": "SELECT user_id AS sent_id, [2, id] AS ids FROM walk WHERE place=1",
    "sentence_scores": """
        SELECT sent_id, step, prev_id, next_id, round(ln(n/sum(n) OVER (PARTITION BY sent_id, step, prev_id)),9) AS logp
        FROM (SELECT user_id AS sent_id, CAST(event_id%3 AS INTEGER) AS step, id AS prev_id, coalesce(next_id,3) AS next_id, count(*)::DOUBLE AS n
              FROM walk GROUP BY ALL)""",
    "toy": f"""
        SELECT CAST(3+row_number() OVER (ORDER BY token) AS INTEGER) AS id, token
        FROM (SELECT DISTINCT unnest(string_split(w,'')) AS token
              FROM (SELECT unnest({sql_words("src")}) AS w FROM pairs))""",
    "toy_map": "SELECT map(list(token), list(id)) AS m FROM toy",
    "toy_pairs": f"""
        SELECT pair_id, split,
               list_concat([2], [coalesce(m[c],1) for c in string_split(array_to_string({sql_words("src")},''),'') if c<>''], [3]) AS src_all,
               list_concat([2], [coalesce(m[c],1) for c in string_split(array_to_string({sql_words("tgt")},''),'') if c<>''], [3]) AS tgt_all
        FROM pairs, toy_map""",
    "cut_pairs": """
        SELECT pair_id, split,
               CASE WHEN len(src_all)>128 THEN list_concat(src_all[1:127],[3]) ELSE src_all END AS src_ids,
               CASE WHEN len(tgt_all)>128 THEN list_concat(tgt_all[1:127],[3]) ELSE tgt_all END AS tgt_ids
        FROM toy_pairs""",
    "placed": """
        SELECT *, idx//16 AS batch_id, CAST(idx%16 AS INTEGER) AS pos FROM (
          SELECT *, row_number() OVER (PARTITION BY split ORDER BY
                   CASE WHEN split='train' THEN md5(concat('7:',pair_id)) ELSE '' END, pair_id)-1 AS idx,
                 count(*) OVER (PARTITION BY split) AS total
          FROM cut_pairs)
        WHERE split<>'train' OR idx < total//16*16""",
    "padded": """
        SELECT split, batch_id, pos, pair_id,
               list_concat(src_ids, [0 for i in range(max(len(src_ids)) OVER w - len(src_ids))]) AS src_ids,
               list_concat(tgt_ids, [0 for i in range(max(len(tgt_ids)) OVER w - len(tgt_ids))]) AS tgt_ids
        FROM placed WINDOW w AS (PARTITION BY split, batch_id)""",
    "sides": """
        SELECT *, tgt_ids[1:len(tgt_ids)-1] AS tgt_in, tgt_ids[2:len(tgt_ids)] AS tgt_out FROM padded""",
    "words": f"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest({sql_words("line")}) AS word FROM lines) GROUP BY word""",
    "train_words": f"""
        SELECT word, count(*) AS n
        FROM (SELECT unnest({sql_words("t")}) AS word
              FROM (SELECT src AS t FROM pairs WHERE split='train'
                    UNION ALL SELECT tgt FROM pairs WHERE split='train'))
        GROUP BY word""",
    "doc_alphabet": """
        SELECT CAST(3+row_number() OVER (ORDER BY token) AS INTEGER) AS id, token
        FROM (SELECT DISTINCT unnest(string_split(word,'')) AS token FROM words)""",
    "line_lengths": f"""
        SELECT doc_id, line_no, CAST(2+length(array_to_string({sql_words("line")},'')) AS INTEGER) AS n_tokens FROM lines""",
}


def with_views(*names: str, more: dict[str, str] | None = None) -> str:
    """A WITH clause of the named views, in order, then ``more``."""
    parts = [f"{n} AS ({CTES[n]})" for n in names]
    parts += [f"{n} AS {'MATERIALIZED ' if n.startswith('m_') else ''}({q})" for n, q in (more or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"


PAIRS_TO_SIDES = ("pairs", "toy", "toy_map", "toy_pairs", "cut_pairs", "placed", "padded", "sides")
TRANSITIONS = ("kinds", "walk", "steps", "transitions", "starts")


# ---- Spark views -----------------------------------------------------------------------


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    turns = spread(table(spark, sf, "conversations"))
    users = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    bucket = F.col("conv_id") % 10
    return users.join(replies, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.when(bucket < 8, "train").when(bucket == 8, "validation").otherwise("test").alias("split"),
        "src",
        "tgt",
    )


def line_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """``(pair_id, en, de)``: lines 2k and 2k+1 of every document, the last ``de`` empty if there is none."""
    cut = table(spark, sf, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    ks = F.sequence(F.lit(0), F.ceil(F.size("l") / 2).cast("int") - 1)
    pairs = F.transform(ks, lambda k: F.struct(
        k.alias("k"), F.get("l", 2 * k).alias("en"), F.coalesce(F.get("l", 2 * k + 1), F.lit("")).alias("de")
    ))
    return cut.select("doc_id", F.inline(pairs)).select((F.col("doc_id") * DOC_LINES + F.col("k")).alias("pair_id"), "en", "de")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        "doc_id", F.posexplode(split_physical_lines(F.col("text"))).alias("at", "line")
    ).select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line")


def hyp_ref(spark: SparkSession, sf: str) -> DataFrame:
    kept = F.filter(F.split("tgt", " "), lambda w, i: i % 7 != 3)
    return pairs(spark, sf).select(
        F.col("pair_id").alias("sent_id"), F.array_join(kept, " ").alias("hyp"), F.col("tgt").alias("ref")
    )


def hyps(spark: SparkSession, sf: str) -> DataFrame:
    return hyp_ref(spark, sf).select("sent_id", "hyp")


def refs(spark: SparkSession, sf: str) -> DataFrame:
    return pairs(spark, sf).select(F.col("pair_id").alias("sent_id"), F.col("tgt").alias("ref"))


def batch_log_of(events: DataFrame) -> DataFrame:
    """Works on a batch or a streaming DataFrame."""
    place = F.col("event_id") % 500
    return events.select(
        (F.floor(F.col("event_id") / 500) + 1).alias("epoch"),
        place.alias("batch_idx"),
        (F.col("value") / 100).alias("loss"),
        F.get_json_object("props", "$.k").cast("long").alias("n_tokens"),
        ((place + 1) * F.lit(0.1)).alias("elapsed_s"),
    )


def batch_log(spark: SparkSession, sf: str) -> DataFrame:
    return batch_log_of(table(spark, sf, "events"))


def epoch_log(spark: SparkSession, sf: str) -> DataFrame:
    def side(name: str, odd: int) -> Column:
        mine = F.col("batch_idx") % 2 == odd
        loss = F.sum(F.when(mine, F.col("loss") * F.col("n_tokens")))
        return (loss / F.greatest(F.sum(F.when(mine, F.col("n_tokens"))), F.lit(1))).alias(name)

    return (
        batch_log(spark, sf)
        .groupBy("epoch")
        .agg(side("train_loss", 0), side("val_loss", 1))
        .withColumn("bleu", F.round(20 + F.col("epoch") - 20 * F.col("train_loss"), 4))
    )


def logits(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "embeddings")).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("logits"), F.col("label").alias("target")
    )


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("series"),
        F.datediff(F.to_date("o_orderdate"), F.lit("1990-01-01").cast("date")).cast("long").alias("x"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("price"),
    )


def known(spark: SparkSession, sf: str) -> DataFrame:
    """Highest price of filled orders by priority and day: a sparse curve per priority."""
    return _priced(spark, sf).filter("status = 'F'").groupBy("series", "x").agg(F.max("price").alias("y"))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return _priced(spark, sf).select("series", "x").distinct()


def _event_ids(spark: SparkSession, sf: str) -> DataFrame:
    # One row per event type: the window without a partition sees only the types.
    kinds = table(spark, sf, "events").select("event_type").distinct()
    return kinds.select(
        "event_type", (F.row_number().over(Window.orderBy("event_type")) + 3).cast("int").alias("id")
    )


def _walk(spark: SparkSession, sf: str) -> DataFrame:
    """Each event with the next event of its user, a user's events cut by day.

    A very active user spreads over many tasks: the window sees one user's day, and
    the first event of the user's next active day is carried over from a table of days.
    """
    event = F.struct("ts", "event_id", "id")
    events = (
        table(spark, sf, "events")
        .join(F.broadcast(_event_ids(spark, sf)), "event_type")
        .select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", "id")
    )
    firsts = events.groupBy("user_id", "day").agg(F.min(event).alias("first"))
    by_day = Window.partitionBy("user_id").orderBy("day")
    carried = firsts.select(
        "user_id",
        "day",
        F.lead("first.id").over(by_day).alias("next_day_id"),
        F.lag("first.id").over(by_day).isNull().alias("first_day"),
        F.col("first.event_id").alias("first_event_id"),
    )
    within = Window.partitionBy("user_id", "day").orderBy("ts", "event_id")
    return (
        events.withColumn("same_day_id", F.lead("id").over(within))
        .join(carried, ["user_id", "day"])
        .select(
            "user_id",
            "event_id",
            "id",
            F.coalesce("same_day_id", "next_day_id").alias("next_id"),
            (F.col("first_day") & (F.col("event_id") == F.col("first_event_id"))).alias("is_first"),
        )
    )


def transitions(spark: SparkSession, sf: str) -> DataFrame:
    walk = _walk(spark, sf)
    after = walk.select(F.col("id").alias("prev_id"), F.coalesce("next_id", F.lit(3)).alias("next_id"))
    begin = walk.filter("is_first").select(F.lit(2).alias("prev_id"), F.col("id").alias("next_id"))
    counted = after.unionByName(begin).groupBy("prev_id", "next_id").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("prev_id"))
    return counted.select("prev_id", "next_id", F.round(F.ln(share), 9).alias("logp"))


def starts(spark: SparkSession, sf: str) -> DataFrame:
    return _walk(spark, sf).filter("is_first").select(
        F.col("user_id").alias("sent_id"), F.array(F.lit(2), F.col("id")).alias("ids")
    )


def sentence_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Scores by sentence (a user) and step: what follows in the user's own events, dealt to three steps."""
    counted = (
        _walk(spark, sf)
        .groupBy(F.col("user_id").alias("sent_id"), (F.col("event_id") % 3).cast("int").alias("step"), F.col("id").alias("prev_id"),
                 F.coalesce("next_id", F.lit(3)).alias("next_id"))
        .agg(F.count("*").alias("n"))
    )
    share = F.col("n") / F.sum("n").over(Window.partitionBy("sent_id", "step", "prev_id"))
    return counted.select("sent_id", "step", "prev_id", "next_id", F.round(F.ln(share), 9).alias("logp"))


def toy_vocabulary(spark: SparkSession, sf: str) -> Vocabulary:
    """Characters of the source side, no merges."""
    return character_vocabulary(word_counts(pairs(spark, sf), "src"))


def toy_pairs(spark: SparkSession, sf: str, max_len: int | None = None) -> DataFrame:
    return encode(
        pairs(spark, sf), toy_vocabulary(spark, sf), {"src": "src_ids", "tgt": "tgt_ids"}, max_len
    ).select("pair_id", "split", "src_ids", "tgt_ids")


def train_lines(spark: SparkSession, sf: str) -> DataFrame:
    both = F.explode(F.array("src", "tgt")).alias("line")
    return pairs(spark, sf).filter("split = 'train'").select(both)


def numbered(df: DataFrame, order_by: list[str]) -> DataFrame:
    return with_row_index(df, order_by, out="at").withColumn("line_no", F.col("at") + 1).drop("at")


ALL_BREAKS = r"\r\n|\r|\n|" + EXTRA_LINE_BREAKS
