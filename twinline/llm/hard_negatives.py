"""Hard negatives by rotated one-bit codes: intervals from popcounts choose what is scored exactly.

A row's vector is rotated and kept as its signs, with its norm and its alignment to the
code (the inner product of the vector and the unit vector along the code). For a query
``q`` and a row ``v = align * c + r``, with ``r`` orthogonal to the code ``c``::

    q . v  =  align * (q . c)  +  (q - (q . c) c) . r

The first term comes from popcounts of the code with the bit planes of the quantised
query; the second is at most the product of the two residual norms (Cauchy-Schwarz). So
each pair has an interval that holds its score for certain, and only pairs whose interval
reaches what is still wanted are scored, in integers.

Queries go in chunks of a fixed size; a chunk is shared with all tasks, each of which
reads its own rows once and sends the best few per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..plans.row_index import with_row_index
from ..plans.sizing import spread
from ..plans.stages import drop_stage, new_path, write_stage

QUERY_BITS = 6  # bit planes of a rotated query
SEED = 11
CHUNK_CELLS = 1 << 21  # components of the queries that are shared at once
BLOCK_CELLS = 1 << 19  # pairs that a task holds at once
_NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 53)
_LAST = (1 << 63) - 1  # orders null ids behind all others

INDEX = "row long, id long, label string, ints array<long>, code binary, norm double, align double"


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    return np.linalg.qr(np.random.default_rng(SEED + dim).standard_normal((dim, dim)))[0]


def encode(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-bit codes (as 64-bit words), norms and alignments of integer vectors."""
    turned = vectors.astype(float) @ rotation(vectors.shape[1])
    dim = vectors.shape[1]
    words = -(-dim // 64)
    bits = np.zeros((len(vectors), words * 64), np.uint8)
    bits[:, :dim] = turned > 0
    codes = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(len(vectors), words)
    return codes, np.sqrt((turned**2).sum(1)), np.abs(turned).sum(1) / np.sqrt(max(dim, 1))


@dataclass
class Queries:
    """Queries of one dimension: exact vectors, and the bit planes of their quantised rotation."""

    place: np.ndarray  # number of the query in its chunk
    row: np.ndarray
    label: np.ndarray
    ints: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    total: np.ndarray
    norm: np.ndarray  # of the quantised query
    lost: np.ndarray  # norm of what quantising took away
    size: np.ndarray  # norm of the query

    @classmethod
    def of(cls, place, row, label, ints) -> Queries:
        turned = ints.astype(float) @ rotation(ints.shape[1])
        n, dim = turned.shape
        low = turned.min(1, initial=0)
        step = (turned.max(1, initial=0) - low) / ((1 << QUERY_BITS) - 1)
        levels = np.rint((turned - low[:, None]) / np.where(step > 0, step, 1)[:, None]).astype(np.uint8)
        seen = low[:, None] + step[:, None] * levels
        words = -(-dim // 64)
        planes = np.zeros((n, QUERY_BITS, words), np.uint64)
        for p in range(QUERY_BITS):
            bits = np.zeros((n, words * 64), np.uint8)
            bits[:, :dim] = (levels >> p) & 1
            planes[:, p] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(n, words)
        norm = lambda x: np.sqrt((x**2).sum(1))
        return cls(place, row, label, ints, planes, low, step, seen.sum(1), norm(seen), norm(turned - seen), norm(turned))

    def take(self, at: np.ndarray) -> Queries:
        return Queries(*[getattr(self, f)[at] for f in self.__dataclass_fields__])


def intervals(q: Queries, codes: np.ndarray, norm: np.ndarray, align: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner product of every query with every row."""
    dim = max(q.ints.shape[1], 1)
    hits = np.zeros((len(q.row), len(codes)))
    for p in range(QUERY_BITS):
        for w in range(codes.shape[1]):
            hits += np.bitwise_count(q.planes[:, p, w][:, None] & codes[:, w][None, :]) * float(1 << p)
    ones = np.bitwise_count(codes).sum(1, dtype=float)
    on_code = (2 * (q.low[:, None] * ones[None, :] + q.step[:, None] * hits) - q.total[:, None]) / np.sqrt(dim)
    middle = on_code * align
    rest = np.sqrt(np.maximum(q.norm[:, None] ** 2 - on_code**2, 0))
    # The last term covers the rounding of the floating-point steps above.
    half = rest * np.sqrt(np.maximum(norm**2 - align**2, 0)) + q.lost[:, None] * norm + 1e-6 * (1 + q.size[:, None] * norm)
    return middle - half, middle + half


def exact_scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of both sides; those beyond 64 bits are cut to the nearest 64-bit integer."""
    most = max(left.shape[1], 1) * float(np.abs(left.astype(float)).max(initial=0)) * float(np.abs(right.astype(float)).max(initial=0))
    if most < _EXACT:
        return (left.astype(float) @ right.T.astype(float)).astype(np.int64)
    wide = left.astype(object) @ right.T.astype(object)
    return np.vectorize(lambda x: max(_NONE + 1, min(_LAST, int(x))), otypes=[np.int64])(wide)


class Best:
    """The best ``k`` rows of every slot so far: higher scores first, ties to the smaller id."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), _NONE)
        self.id = np.full((slots, k), _LAST)

    def least(self) -> np.ndarray:
        """What a row must reach to enter a slot."""
        return self.score[:, -1]

    def offer(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        touched = np.unique(slot)
        slots = np.concatenate((slot, np.repeat(touched, self.k)))
        scores = np.concatenate((score, self.score[touched].ravel()))
        ids = np.concatenate((ids, self.id[touched].ravel()))
        order = np.lexsort((ids, ~scores, slots))  # ~x falls where x rises, and never overflows
        slots, scores, ids = slots[order], scores[order], ids[order]
        rank = np.arange(len(slots)) - np.searchsorted(slots, slots)
        kept = rank < self.k
        self.score[slots[kept], rank[kept]] = scores[kept]
        self.id[slots[kept], rank[kept]] = ids[kept]

    def table(self) -> pa.RecordBatch:
        slot, rank = np.nonzero(self.score != _NONE)
        ids = self.id[slot, rank]
        return pa.RecordBatch.from_arrays(
            [pa.array(slot.astype(np.int64)), pa.array(self.score[slot, rank]), pa.array(ids, mask=ids == _LAST)], ["slot", "score", "id"]
        )


def _rows_by_dim(batch: pa.RecordBatch) -> Iterator[dict]:
    vectors = batch.column("ints")
    lengths = np.diff(vectors.offsets.to_numpy())
    flat, ends = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        ints = flat[ends[at][:, None] + np.arange(dim)]
        get = lambda c: batch.column(c).take(pa.array(at))
        yield {
            "ints": ints, "row": get("row").to_numpy(), "id": get("id").fill_null(_LAST).to_numpy(),
            "label": get("label").to_numpy(zero_copy_only=False).astype(object), "norm": get("norm").to_numpy(), "align": get("align").to_numpy(),
            "codes": np.frombuffer(b"".join(get("code").to_pylist()), "<u8").reshape(len(at), -(-int(dim) // 64)),
        }


def _offer_block(best: Best, slots: np.ndarray, valid: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
    """Offer the valid pairs of a block (queries by rows); of many, only those that reach the block's own k-th."""
    if valid.sum() > 16 * len(slots) and valid.shape[1] > best.k:
        held = np.where(valid, scores, _NONE)
        valid = valid & (scores >= np.partition(held, -best.k, axis=1)[:, -best.k][:, None])
    a, r = np.nonzero(valid)
    if len(a):
        best.offer(slots[a], scores[a, r], ids[r])


def nearest_of_label(queries: list[Queries], n: int, rows: Iterator[dict], k: int) -> tuple[Best, int, int]:
    """The ``k`` best other rows of each query's own label; also the pairs met and those scored."""
    best, met, scored = Best(n, k), 0, 0
    for part in rows:
        for q_all in (q for q in queries if q.ints.shape[1] == part["ints"].shape[1]):
            for label in set(part["label"].tolist()):
                q = q_all.take(np.flatnonzero(q_all.label == label))
                own = np.flatnonzero(part["label"] == label)
                if not len(q.row):
                    continue
                wide = max(1, BLOCK_CELLS // len(q.row))
                for at in (own[i : i + wide] for i in range(0, len(own), wide)):
                    lower, upper = intervals(q, part["codes"][at], part["norm"][at], part["align"][at])
                    other = q.row[:, None] != part["row"][at][None, :]
                    wanted = best.least()[q.place].astype(float)
                    if len(at) > k:  # k rows reach their lower bounds, so the k-th of these is reached as well
                        wanted = np.maximum(wanted, np.partition(np.where(other, lower, -np.inf), -k, axis=1)[:, -k])
                    valid = other & (upper >= wanted[:, None])
                    met, scored = met + valid.size, scored + int(valid.sum())
                    some = np.flatnonzero(valid.any(axis=0))
                    scores = exact_scores(q.ints, part["ints"][at[some]])
                    valid = valid[:, some] & (scores >= best.least()[q.place][:, None])
                    _offer_block(best, q.place, valid, scores, part["id"][at[some]])
    return best, met, scored


def best_in_windows(queries: list[Queries], n: int, windows: np.ndarray, rows: Iterator[dict], k: int) -> tuple[Best, int, int]:
    """The ``k`` best rows of another label inside each of a query's score windows ``(n, m, 2)``; slot ``query * m + j``."""
    m = windows.shape[1]
    best, met, scored = Best(n * m, k), 0, 0
    for part in rows:
        for q in (q for q in queries if q.ints.shape[1] == part["ints"].shape[1]):
            wide = max(1, BLOCK_CELLS // max(len(q.row), 1))
            for at in (np.arange(i, min(i + wide, len(part["row"]))) for i in range(0, len(part["row"]), wide)):
                lower, upper = intervals(q, part["codes"][at], part["norm"][at], part["align"][at])
                other = q.label[:, None] != part["label"][at][None, :]
                slots = q.place[:, None] * m + np.arange(m)
                low = np.maximum(windows[q.place, :, 0], best.least()[slots])
                high = windows[q.place, :, 1]
                valid = np.zeros_like(other)
                for j in range(m):
                    valid |= (upper >= low[:, j, None]) & (lower <= high[:, j, None]) & (low <= high)[:, j, None]
                valid &= other
                met, scored = met + valid.size, scored + int(valid.sum())
                some = np.flatnonzero(valid.any(axis=0))
                if not len(some):
                    continue
                scores, valid = exact_scores(q.ints, part["ints"][at[some]]), valid[:, some]
                for j in range(m):
                    inside = valid & (scores >= low[:, j, None]) & (scores <= high[:, j, None])
                    _offer_block(best, slots[:, j], inside, scores, part["id"][at[some]])
    return best, met, scored


def build_index(rows: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``INDEX`` rows of all vectors that take part: integers, code, norm and alignment, written once."""
    usable = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale))
    taken = spread(rows.select(id_col, label_col, vector_col)).filter(F.col(label_col).isNotNull() & F.coalesce(usable, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("string").alias("label"), whole.alias("ints"),
    )

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("ints")
            ends = vectors.offsets.to_numpy()
            lengths, flat, n = np.diff(ends), vectors.values.to_numpy(), len(vectors)
            code, norm, align = [b""] * n, np.zeros(n), np.zeros(n)
            for dim in np.unique(lengths):
                at = np.flatnonzero(lengths == dim)
                codes, norm[at], align[at] = encode(flat[ends[at][:, None] + np.arange(dim)])
                for i, c in zip(at, codes):
                    code[i] = c.tobytes()
            more = [pa.array(code, pa.binary()), pa.array(norm), pa.array(align)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["row", "id", "label", "ints", "code", "norm", "align"])

    index, _ = write_stage(taken.mapInArrow(encoded, INDEX), "code-index")
    return index


def _top(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def _scan(index: DataFrame, step, args: tuple) -> DataFrame:
    """Run ``step(*args, rows, k)`` over all rows of the index, one call a task; ``args`` are shared, of bounded size."""
    shared = index.sparkSession.sparkContext.broadcast(args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *first, k = shared.value
        yield step(*first, (p for b in batches for p in _rows_by_dim(b)), k)[0].table()

    return index.mapInArrow(run, "slot long, score long, id long")


def hard_negatives(
    rows: DataFrame,
    anchors: str,
    n_positives: int = 5,
    n_negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    chunk_cells: int = CHUNK_CELLS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    A component becomes ``floor(scale * x)``; a score is the integer inner product with the
    anchor. An anchor's positives are its ``n_positives`` best other rows of its label; for
    each of them come the ``n_negatives`` best rows of another label whose score is ``low`` to
    ``high`` percent of the positive's. Higher scores come first, ties by smaller id.
    ``anchors`` is an SQL condition on ``id`` (the ids as ``id_col`` holds them).

    Rows with a null label, a null vector or a null or non-finite component take no part.
    Vectors are compared with those of the same length only; vectors without components score
    0. Rows that repeat an id are rows of their own, also as anchors, and each is another row
    to the others. Null ids are no anchors unless the condition says so, and come last in ties.
    Scores beyond 64 bits are cut to the nearest 64-bit integer. Other columns are not looked
    at. An anchor without positives, or a positive without negatives, has no rows; an empty
    table gives an empty result.

    Every pair of an anchor and a row is bounded; nothing is sampled. Anchors go in chunks of
    ``chunk_cells`` components, so what is shared and what returns to the driver is bounded.
    """
    spark = rows.sparkSession
    index = build_index(rows, id_col, label_col, vector_col, scale)
    asked = with_row_index(index.filter(anchors).select("row", "id", "label", "ints"), ["row"], out="place")
    longest, n_asked = asked.agg(F.max(F.size("ints")), F.count("*")).first()
    per_chunk = max(1, chunk_cells // max(longest or 1, 1))
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    result = new_path(spark, "hard-negatives")
    spark.createDataFrame([], out).write.parquet(result)
    for first in range(0, n_asked, per_chunk):
        mine = asked.filter((F.col("place") >= first) & (F.col("place") < first + per_chunk))
        chunk = mine.orderBy("place").toArrow()
        queries = []
        vectors = chunk.column("ints").combine_chunks()
        lengths = np.array([len(x) for x in vectors])
        for dim in np.unique(lengths):
            at = np.flatnonzero(lengths == dim)
            take = lambda c: chunk.column(c).take(pa.array(at))
            ints = np.array(take("ints").to_pylist(), np.int64).reshape(len(at), dim)
            queries.append(Queries.of(at, take("row").to_numpy(), np.array(take("label").to_pylist(), object), ints))
        n = len(chunk)
        found, path = write_stage(_top(_scan(index, nearest_of_label, (queries, n, n_positives)), n_positives), "positives")
        windows = np.zeros((n, n_positives, 2), np.int64)
        windows[:, :, 0] = 1  # an empty window
        cut = lambda x: max(_NONE + 1, min(_LAST, x))
        for p in found.collect():  # at most n_positives a query of the chunk
            windows[p.slot, p.rank - 1] = cut(-(-low * p.score // 100)), cut(high * p.score // 100)
        negatives, other = write_stage(_top(_scan(index, best_in_windows, (queries, n, windows, n_negatives)), n_negatives), "negatives")
        ids = mine.select((F.col("place") - first).alias("q"), F.col("id").alias("anchor_id"))
        named = found.select(
            F.col("slot").alias("q"), (F.col("slot") * n_positives + F.col("rank") - 1).alias("slot"),
            F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
        ).join(ids, "q")
        one = negatives.select("slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, "slot")
        one.select(*[c.split()[0] for c in out.split(", ")]).write.mode("append").parquet(result)
        for written in (path, other):
            drop_stage(spark, written)
    return spark.read.schema(out).parquet(result)
