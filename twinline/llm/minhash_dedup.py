"""Near-duplicate documents by weighted MinHash from hashed darts (DartMinHash).

The weighted elements of a document are its five-word shingles with their counts. Every
element owns a region of width "count" along a weight axis; darts fall on the plane of
(weight, rank) at fixed hashed places, the same for every document. A document is hit by
the darts that lie in its elements' regions below a rank limit chosen so that a fixed
number is expected. Each dart belongs to one coordinate of the signature, which keeps its
earliest dart (lowest rank): two documents share it with probability equal to their
weighted Jaccard similarity. Cost per document is one pass over its shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from ..plans.sizing import BROADCAST_BYTES, small_side
from ..plans.stages import drop_stage, stage_bytes, write_stage
from .components import stars
from .words import chunks, cut, grams, mix

SHINGLE = 5
BANDS, ROWS = 20, 4
SIGNATURE = BANDS * ROWS
LEADERS = (3, 3)  # of every mixed bucket, drawn in each turn between the first and the last
FEW = 0.1  # pairs a bucket row: when no more are left, they are compared without further leaders
PARITIES = 16  # 64-bit words of parity bits a document
LOW_RANK = -4  # ranks below 2**LOW_RANK form one strip; above it strips grow fourfold
_SKETCH = T.StructType([
    T.StructField("node", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())),
    *[T.StructField(f"p{i}", T.LongType()) for i in range(PARITIES)],
])
_TINY = 2.0**-53
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, hash and count of the distinct shingles of a chunk of texts, sorted by owner and hash.

    A text of one to four words is one shingle; a text without words has none.
    """
    words = cut(texts)
    hashes, at = grams(words.hashes, words.owner, SHINGLE)
    owner = words.owner[at]
    firsts = words.firsts()
    size = np.diff(firsts)
    for i in np.flatnonzero((size > 0) & (size < SHINGLE)):
        own = words.hashes[firsts[i] : firsts[i + 1]]
        value = np.uint64(len(own))
        for h in own:
            value = mix(np.array([value]) * np.uint64(31) + h)[0]
        hashes, owner = np.append(hashes, value), np.append(owner, i)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], hashes[first], np.diff(np.append(first, len(hashes)))


def _thrown(element: np.ndarray, strip: int, cells: np.ndarray, area: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts of a strip: index of the element, cell number and dart hash. ``area`` is per cell, at most 1."""
    seed = mix(element + np.uint64(strip * int(_STEP) % 2**64))
    if cells.max(initial=1) == 1:
        of, cell = np.arange(len(element)), np.zeros(len(element), np.int64)
    else:
        of = np.repeat(np.arange(len(element)), cells)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(cells) - cells, cells)
        seed = np.where(cell == 0, seed[of], mix(seed[of] + cell.astype(np.uint64)))
    u = (seed >> np.uint64(11)).astype(np.float64) * _TINY
    term = math.exp(-area)
    below, alive, j = term, np.flatnonzero(u >= term), 0
    found, cell_of, ids = [], [], []
    while alive.size:
        j += 1
        found.append(of[alive])
        cell_of.append(cell[alive])
        ids.append(mix(seed[alive] + np.uint64(j * int(_STEP) % 2**64)))
        term *= area / j
        below += term
        alive = alive[(u[alive] >= below) & (j < 40)]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(found), np.concatenate(cell_of), np.concatenate(ids)


def signatures(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int, k: int = SIGNATURE) -> np.ndarray:
    """Signature rows (dart ids) of all texts that have shingles; the others stay zero."""
    out = np.zeros((n_texts, k), np.uint64)
    totals = np.bincount(owner, weights=counts, minlength=n_texts)
    wanted, darts = np.flatnonzero(totals > 0), k * math.log(k) + 2 * k
    while wanted.size:
        limit = np.zeros(n_texts)
        limit[wanted] = darts / totals[wanted]
        use = np.flatnonzero(limit[owner] > 0)
        el_owner, el_hash, el_count = owner[use], hashes[use], counts[use].astype(np.float64)
        el_limit = limit[el_owner]
        got_owner, got_rank, got_id = [], [], []
        strip_w = 0
        while True:
            w_low, w_high = (0.0, 1.0) if strip_w == 0 else (2.0 ** (strip_w - 1), 2.0**strip_w)
            tall = np.flatnonzero(el_count > w_low)
            if not tall.size:
                break
            strip_r = 0
            while True:
                r_low, r_high = (0.0, 2.0**LOW_RANK) if strip_r == 0 else (2.0 ** (LOW_RANK + 2 * strip_r - 2), 2.0 ** (LOW_RANK + 2 * strip_r))
                reach = tall[el_limit[tall] > r_low]
                if not reach.size:
                    break
                full = (w_high - w_low) * (r_high - r_low)
                n_cells = max(1, math.ceil(full))
                # cells divide the strip along the rank axis; those above the limit need no darts
                height = (r_high - r_low) / n_cells
                cells = np.minimum(n_cells, np.ceil((el_limit[reach] - r_low) / height)).astype(np.int64)
                of, cell, dart = _thrown(el_hash[reach], strip_w * 64 + strip_r, cells, full / n_cells)
                where = mix(dart ^ np.uint64(0x5851F42D4C957F2D))
                weight = w_low + (w_high - w_low) * ((where >> np.uint64(40)).astype(np.float64) * 2.0**-24)
                inside = (mix(where + _STEP) >> np.uint64(11)).astype(np.float64) * _TINY
                rank = r_low + (cell + inside) * height
                at = reach[of]
                keep = (weight < el_count[at]) & (rank < el_limit[at])
                got_owner.append(el_owner[at[keep]])
                got_rank.append(rank[keep])
                got_id.append(dart[keep])
                strip_r += 1
            strip_w += 1
        d_owner, d_rank, d_id = map(np.concatenate, (got_owner, got_rank, got_id))
        coordinate = (mix(d_id + np.uint64(0xA0761D6478BD642F)) % np.uint64(k)).astype(np.int64)
        slot = d_owner * k + coordinate
        late_first = np.argsort(-d_rank)
        out.reshape(-1)[slot[late_first]] = d_id[late_first]  # of several writes to a slot the last, the earliest dart, stays
        filled = np.zeros(n_texts * k, bool)
        filled[slot] = True
        hit = filled.reshape(n_texts, k).sum(axis=1)
        wanted, darts = wanted[hit[wanted] < k], darts * 2  # an empty coordinate: throw twice as many
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key * np.uint64(31) + parts[:, :, r])
    return key


def parities(owner: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_texts: int) -> np.ndarray:
    """Bits that tell whether an odd number of a text's shingles hash to them.

    Two texts differ in no more bits than in shingles, so the bits rule pairs out without error.
    """
    out = np.zeros(n_texts * PARITIES, np.uint64)
    odd = counts % 2 == 1
    bit = mix(hashes[odd] + np.uint64(0xE7037ED1A0B428DB)) % np.uint64(64 * PARITIES)
    np.bitwise_xor.at(out, owner[odd] * PARITIES + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out.reshape(n_texts, PARITIES).view(np.int64)


def sketch(texts: list[str | None]) -> pd.DataFrame:
    """Identity of the shingle multiset, its size, band keys and parities; null identity without words."""
    ident, total, bands = [None] * len(texts), np.zeros(len(texts), np.int64), [None] * len(texts)
    bits = np.zeros((len(texts), PARITIES), np.int64)
    for first, chunk in chunks(texts):
        owner, hashes, counts = shingles(chunk)
        keys = band_keys(signatures(owner, hashes, counts, len(chunk))).view(np.int64)
        n = np.bincount(owner, weights=counts, minlength=len(chunk)).astype(np.int64)
        bits[first : first + len(chunk)] = parities(owner, hashes, counts, len(chunk))
        start = np.searchsorted(owner, np.arange(len(chunk) + 1))
        for i in np.flatnonzero(n):
            s = slice(start[i], start[i + 1])
            raw = hashes[s].tobytes() + counts[s].astype(np.int64).tobytes()
            ident[first + i] = hashlib.blake2b(raw, digest_size=16).digest()
            total[first + i] = n[i]
            bands[first + i] = keys[i]
    return pd.DataFrame({"node": ident, "n": total, "bands": bands} | {f"p{i}": bits[:, i] for i in range(PARITIES)})


def similarities(left: list[str], right: list[str]) -> np.ndarray:
    """Exact weighted Jaccard similarity of the shingles of each pair of texts."""
    out = np.zeros(len(left))
    for first, chunk in chunks(left):
        a = shingles(chunk)
        b = shingles(list(right[first : first + len(chunk)]))
        pair = np.concatenate((a[0], b[0]))
        gram = np.concatenate((a[1], b[1]))
        count = np.concatenate((a[2], b[2]))
        order = np.lexsort((gram, pair))
        pair, gram, count = pair[order], gram[order], count[order]
        same = np.flatnonzero((pair[1:] == pair[:-1]) & (gram[1:] == gram[:-1]))
        shared = np.bincount(pair[same], weights=np.minimum(count[same], count[same + 1]), minlength=len(chunk))
        total = np.bincount(pair, weights=count, minlength=len(chunk))
        out[first : first + len(chunk)] = shared / np.maximum(total - shared, 1)
    return out


@F.pandas_udf(_SKETCH)
def _sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield sketch(texts.tolist())


@F.pandas_udf(T.DoubleType())
def _similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series(similarities(left.tolist(), right.tolist()))


def _verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("_ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("_tb"))
    scored = pairs.join(a, "a").join(b, "b").withColumn("_s", _similarity("_ta", "_tb"))
    return scored.filter(F.col("_s") >= threshold).select("a", "b")


def _if_small(stage: DataFrame, path: str) -> DataFrame:
    return F.broadcast(stage) if stage_bytes(stage.sparkSession, path) <= BROADCAST_BYTES else stage


def _named(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``la, lb``: the components that the two ends of the pairs are known to lie in, so far."""
    if comp is None:
        return pairs.withColumns({"la": F.col("a"), "lb": F.col("b")})
    for end in "ab":
        known = comp.select(F.col("node").alias(end), F.col("comp").alias(f"l{end}"))
        pairs = pairs.join(known, end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return pairs


def _joined_on(links: DataFrame, comp: DataFrame | None) -> tuple[DataFrame, str]:
    """``(node, comp)`` after the links: ``comp`` is a smaller node of the same component, not always its smallest.

    Twice every end of a link, and what it hung on, hangs on the smaller of the two names. That joins most of what the
    links join at a fixed cost; the components themselves are settled once, when all links are known.
    """
    spark = links.sparkSession
    old_path = None
    for _ in range(2):
        ends = _named(links, comp).withColumn("low", F.least("la", "lb"))
        told = ends.select(F.explode(F.array("a", "b", "la", "lb")).alias("node"), F.col("low").alias("comp"))
        told = told if comp is None else told.unionByName(comp.select("node", "comp"))
        stage, path = write_stage(told.groupBy("node").agg(F.min("comp").alias("comp")), "labels")
        comp = _if_small(stage, path)
        if old_path is not None:
            drop_stage(spark, old_path)
        old_path = path
    further = comp.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
    hung = comp.join(further, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp")).filter("node <> comp")
    out = write_stage(hung, "labels")
    drop_stage(spark, old_path)
    return out


def near_duplicate_classes(
    docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: ``doc_id, text_hash, class_id, n_shingles, kept, same_id``.

    Documents are linked when the weighted Jaccard similarity of their five-word shingles
    is at least ``threshold`` (verified on whole texts); a class is a connected component of
    links, named by its smallest id, whose document is ``kept``. ``text_hash`` is xxhash64 of
    the text, ``same_id`` the number of rows that are kept under the same id in the class.

    Documents with the same shingles are one node from the start, so copies are never paired.
    In a bucket, nodes are first compared with its smallest one; while the buckets that still hold several
    components hold more than ``FEW`` pairs a bucket row, their nodes are compared with ``LEADERS`` other nodes of the
    bucket a turn, which differ from band to band. In buckets that are still mixed, every node outside the
    bucket's largest component then meets all nodes of other components, so no pair of a bucket
    is left out, while nodes that are already joined never meet; a pair that shares several bands
    is taken up in one of them alone. Sizes and parity bits rule most
    pairs out inside these joins; what passes is verified. Until all links are known, the components in
    this are partial ones (``_joined_on``), so that a turn takes few shuffles; a node known to be in one is.

    Null, empty and wordless texts are classes of their own and kept. Rows that repeat an id
    and a text are equal members of a class (each is returned). A null id never names a class
    that has another id. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("_t"))
    bits = [f"p{i}" for i in range(PARITIES)]
    drawn = rows.withColumn("_s", _sketch("_t")).select("doc_id", "text_hash", "_s.*")
    spark = docs.sparkSession
    sketches, _ = write_stage(drawn, "sketches")
    alike = sketches.filter("node IS NOT NULL").groupBy("node").agg(
        F.min("text_hash").alias("text_hash"), F.first("bands").alias("bands"), *[F.first(c).alias(c) for c in ("n", *bits)]
    )
    nodes, nodes_path = write_stage(alike, "nodes")
    # Twenty rows a node: they carry nothing but the node, until the bands of a single node are gone.
    banded = nodes.select("node", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high")
    held = banded.join(shared.select("band", "low"), "band").groupBy("node").agg(F.collect_set(F.struct("band", "low")).alias("held"))
    # One row a node, with its bands that others share and the smallest node of each.
    members, members_path = write_stage(nodes.select("node", "text_hash", "n", *bits).join(held, "node"), "members")
    drop_stage(spark, nodes_path)
    known = _if_small(members, members_path)
    found = docs.select(F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).join(known.select("node", "text_hash"), "text_hash")
    texts, texts_path = write_stage(found.dropDuplicates(["node"]).select("node", "text"), "member-texts")
    n_rows, text_bytes = members.agg(F.sum(F.size("held"))).first()[0] or 0, texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    near_texts = F.broadcast(texts) if text_bytes <= BROADCAST_BYTES else texts

    columns = ["n", *bits]
    differ = " + ".join(f"bit_count({c} ^ {c}_b)" for c in bits)
    fits = (F.least("n", "n_b") >= threshold * F.greatest("n", "n_b")) & (
        (1 + threshold) * F.expr(differ) <= (1 - threshold) * (F.col("n") + F.col("n_b")) + 1e-6
    )
    comp = comp_path = None  # nodes of a component named by another node
    edges, done, done_bytes = None, None, 0
    written = [members_path, texts_path]
    turns = ["low", *LEADERS, "rest"]
    while turns:
        turn = turns.pop(0)
        placed = members.withColumn("comp", F.col("node"))
        if comp is not None:
            placed = members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        if turn == "low":  # at first every node is a component, and every bucket is mixed
            met = members.withColumn("lead", F.explode(F.array_distinct(F.col("held.low")))).filter("node <> lead")
        else:
            buckets = placed.withColumn("band", F.explode("held.band"))
            drawn = [F.min(F.struct(F.xxhash64("node", "band", F.lit(turn * len(turns) + i)).alias("o"), "node")) for i in range(0 if turn == "rest" else turn)]
            parts = buckets.groupBy("band", "comp").agg(F.count("*").alias("m"), *[c.alias(f"l{i}") for i, c in enumerate(drawn)])
            sized = parts.groupBy("band").agg(
                F.max(F.struct("m", "comp")).alias("main"), F.count("*").alias("k"), F.sum("m").alias("size"),
                F.array_distinct(F.array(*[F.min(f"l{i}")["node"] for i in range(len(drawn))])).cast("array<binary>").alias("leads"),
            )
            mixed, path = write_stage(sized.filter("k > 1").select("band", "main", "size", "leads"), "mixed-buckets")
            written.append(path)
            if turn != "rest":
                pairs_left = mixed.agg(F.sum((F.col("size") - F.col("main.m")) * F.col("size").cast("double"))).first()[0] or 0.0
                if pairs_left <= FEW * n_rows:
                    turn, turns = "rest", []
            open_ = buckets.join(_if_small(mixed, path).select("band", F.col("main.comp").alias("main"), "leads"), "band")
        if turn == "rest":
            # A pair is taken up in the smallest band it shares; of two nodes outside the main component, once.
            before = F.filter("held.band", lambda key: key < F.col("band"))
            open_, path = write_stage(open_.select("node", "comp", "main", "band", *columns, before.alias("earlier")), "open-buckets")
            written.append(path)
            x, sides = open_.filter("comp <> main"), ["node", "comp", *columns, "earlier"]
            y = open_.select("band", *[F.col(c).alias(f"{c}_b") for c in sides])
            once = (F.col("comp") != F.col("comp_b")) & ((F.col("comp_b") == F.col("main")) | (F.col("node") < F.col("node_b")))
            pairs = x.join(y, "band").filter(once & fits & ~F.arrays_overlap("earlier", "earlier_b"))
        else:
            if turn != "low":
                met = open_.withColumn("lead", F.explode("leads"))
            lead = members.select(F.col("node").alias("lead"), *[F.col(c).alias(f"{c}_b") for c in columns])
            if turn != "low":
                lead = placed.select(F.col("node").alias("lead"), F.col("comp").alias("comp_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
            lead = F.broadcast(lead) if stage_bytes(spark, members_path) <= BROADCAST_BYTES else lead
            pairs = met.join(lead, "lead").withColumnRenamed("lead", "node_b")
            pairs = pairs.filter(fits if turn == "low" else (F.col("comp") != F.col("comp_b")) & fits)
        pairs = pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b"))
        if turn not in ("low", "rest"):  # in those no pair comes twice
            pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(F.broadcast(done) if done_bytes <= BROADCAST_BYTES else done, ["a", "b"], "left_anti")
        pairs, path = write_stage(pairs, "candidates")
        written.append(path)
        if not pairs.count():
            turns = turns[-1:]
            continue
        done, done_bytes = pairs if done is None else done.unionByName(pairs), done_bytes + stage_bytes(spark, path)
        links, path = write_stage(_verified(_if_small(pairs, path), near_texts, threshold), "links")
        written.append(path)
        if not links.count():
            turns = turns[-1:]
            continue
        edges = links if edges is None else edges.unionByName(links)
        if turns:
            hung, path = _joined_on(links, comp)
            comp = _if_small(hung, path)
            if comp_path is not None:
                drop_stage(spark, comp_path)
            comp_path = path
    placed = sketches.drop("bands", *bits).withColumn("comp", F.col("node"))
    if comp is not None:
        placed = placed.drop("comp").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    if edges is not None:
        # The partial components are joined to whole ones by the links between them.
        settled, path = stars(_named(edges, comp).select(F.col("la").alias("a"), F.col("lb").alias("b")))
        whole = _if_small(settled, path).select(F.col("a").alias("comp"), F.col("b").alias("_whole"))
        placed = placed.join(whole, "comp", "left").withColumn("comp", F.coalesce("_whole", "comp")).drop("_whole")
    for path in written:
        drop_stage(spark, path)
    least = placed.filter("comp IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("class_id"))
    classed = placed.join(least, "comp", "left")
    lone = F.col("node").isNull()
    named = classed.select(
        "doc_id", "text_hash", "comp",
        F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.col("n").alias("n_shingles"),
        (lone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"),
    )
    again = named.filter("kept AND comp IS NOT NULL").groupBy("comp").agg(F.count("*").alias("same_id"))
    return named.join(again, "comp", "left").select(
        "doc_id", "text_hash", "class_id", "n_shingles", "kept", F.coalesce("same_id", F.lit(1)).cast("long").alias("same_id")
    )


def drop_near_duplicates(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of every class, with all columns of ``docs``; of rows that repeat the kept id and text, any one."""
    classes = near_duplicate_classes(docs, threshold, id_col, text_col)
    # Per id and text one verdict: rows that repeat both share it.
    verdict = classes.groupBy(F.col("doc_id").alias("_i"), F.col("text_hash").alias("_h")).agg(
        F.first("kept").alias("_kept"), F.max("same_id").alias("_same"), F.max((F.col("n_shingles") > 0).cast("int")).alias("_worded"),
        F.first("class_id").alias("_class"),
    )
    side = small_side(verdict.filter("NOT _kept OR (_same > 1 AND _worded = 1)"), "verdicts")
    rows = docs.join(side, F.col(id_col).eqNullSafe(F.col("_i")) & (F.xxhash64(F.col(text_col)) == F.col("_h")), "left")
    sure = rows.filter("_kept IS NULL").select(docs["*"])
    repeated = rows.filter("_kept").dropDuplicates(["_class"]).select(docs["*"])
    return sure.unionByName(repeated)
