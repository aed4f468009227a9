"""Resharding by minimum-cost flow: fill new shards to equal counts while moving the fewest bytes.

The old layout deals rows to ``old_shards`` by key. Each old shard is cut, from its smallest
row up, into blocks; a block may stay (if its shard still exists) or go to any new shard at
the price of its bytes. A flow from blocks to shard capacities of least price says how many
rows of each block go where; only shards that give or take rows have to be rewritten.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.row_index import with_row_index
from ..plans.sizing import small_side
from ..plans.stages import drop_stage, write_stage

ROW_OVERHEAD = 8
BLOCKS = 32  # per old shard


def size_of(text_col: str) -> Column:
    """Bytes of a row: its text in UTF-8 (null: none) plus ``ROW_OVERHEAD``."""
    return (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_OVERHEAD).cast("long")


def text_crc32(text_col: str) -> Column:
    return F.crc32(F.coalesce(F.col(text_col), F.lit(""))).cast("long")


def old_shard(n: int) -> Column:
    """The old layout: rows dealt by key; null ids spread by their text."""
    return F.pmod(F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_crc32"))), F.lit(n)).cast("int")


def cheapest_flow(supply: list[int], capacity: list[int], price: dict[tuple[int, int], float]) -> dict[tuple[int, int], int]:
    """Units from each source to each sink, all supply placed within capacity at least total price.

    Successive shortest paths with potentials over the bipartite graph of blocks and shards;
    its size depends on the numbers of blocks and shards only.
    """
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = defaultdict(int)
    left, room = list(supply), list(capacity)
    out = [[(j, price[i, j]) for j in range(m) if (i, j) in price] for i in range(n)]
    used: list[set[int]] = [set() for _ in range(m)]  # blocks with flow into a shard
    high_i, high_j = [0.0] * n, [0.0] * m
    for source in range(n):
        while left[source]:
            best = {("i", source): 0.0}
            back: dict = {}
            heap = [(0.0, 0, source)]
            goal = None
            settled = set()
            while heap:
                d, kind, x = heapq.heappop(heap)
                node = ("j" if kind else "i", x)
                if node in settled:
                    continue
                settled.add(node)
                if kind and room[x]:
                    goal = x
                    break
                if kind:
                    steps = [(("i", i), -price[i, x] + high_j[x] - high_i[i], 0, i) for i in used[x]]
                else:
                    steps = [(("j", j), p + high_i[x] - high_j[j], 1, j) for j, p in out[x]]
                for to, cost, to_kind, y in steps:
                    reach = d + max(cost, 0.0)
                    if to not in settled and reach < best.get(to, float("inf")):
                        best[to], back[to] = reach, node
                        heapq.heappush(heap, (reach, to_kind, y))
            if goal is None:
                raise ValueError("capacities do not hold the supply")
            far = best["j", goal]
            for (side, x), d in best.items():
                d = min(d, far)
                (high_j if side == "j" else high_i)[x] += d - far
            path, at = [], ("j", goal)
            while at in back:
                path.append((back[at], at))
                at = back[at]
            amount = min([left[source], room[goal], *[flow[b[1], a[1]] for a, b in path if a[0] == "j"]])
            for a, b in path:
                if a[0] == "i":
                    flow[a[1], b[1]] += amount
                    used[b[1]].add(a[1])
                else:
                    flow[b[1], a[1]] -= amount
                    if not flow[b[1], a[1]]:
                        used[a[1]].discard(b[1])
            left[source] -= amount
            room[goal] -= amount
    return {k: v for k, v in flow.items() if v}


def reshard(docs: DataFrame, shards: int = 24, old_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, size, text_crc32, old_shard, shard, slot, moved``. Law ``rows``: counts differ by one at most.

    ``size`` is the text's UTF-8 bytes plus 8 (null: 8), ``slot`` numbers a shard's rows without
    gaps from 0. Old shards beyond ``shards`` give all rows away; of any other, the smallest rows
    move, in whole blocks but for the last. Equal texts are not held together: a group may hold a
    third of all rows. Rows that repeat are placed each on its own; null ids are spread by
    text. Works for fewer rows than shards; an empty table gives an empty result.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), size_of(text_col).alias("size"), text_crc32(text_col).alias("text_crc32"),
    ).withColumn("old_shard", old_shard(old_shards))
    # Narrow rows only: 28 bytes each, whatever the texts weigh.
    ranked, _ = write_stage(with_row_index(rows, ["size", "doc_id", "text_crc32"], ["old_shard"], "rank", "total"), "ranked")
    block = F.floor(F.col("rank") * BLOCKS / F.col("total")).cast("int")
    blocks = ranked.groupBy("old_shard", block.alias("block")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.min("rank").alias("first")
    ).orderBy("old_shard", "block").collect()  # old_shards * BLOCKS rows at most
    total = sum(b.rows for b in blocks)
    held = [sum(b.rows for b in blocks if b.old_shard == s) for s in range(shards)]
    fuller = set(sorted(range(shards), key=lambda s: (-held[s], s))[: total % shards])
    capacity = [total // shards + (s in fuller) for s in range(shards)]
    price = {(i, s): 0.0 if b.old_shard == s else b.bytes / b.rows for i, b in enumerate(blocks) for s in range(shards)}
    flow = cheapest_flow([b.rows for b in blocks], capacity, price)
    plan = []
    for i, b in enumerate(blocks):
        at = b.first
        for s in sorted((s for j, s in flow if j == i), key=lambda s: (s == b.old_shard, s)):  # movers are the smaller rows
            plan.append((b.old_shard, at, at + flow[i, s], s))
            at += flow[i, s]
    spark = docs.sparkSession
    # One row per transfer; bounded by blocks and shards. A row lies in exactly one range of its old shard.
    moves = spark.createDataFrame(plan, "old_shard int, lo long, hi long, shard int")
    per_old = moves.groupBy("old_shard").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("ranges"))
    hit = F.get(F.filter("ranges", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"])), F.lit(0))["shard"]
    placed = ranked.join(F.broadcast(per_old), "old_shard").select("doc_id", "size", "text_crc32", "old_shard", hit.alias("shard"))
    numbered = with_row_index(placed, ["doc_id", "text_crc32", "size"], ["shard"], "slot")
    return numbered.select("*", (F.col("shard") != F.col("old_shard")).alias("moved"))


def affected_shards(placed: DataFrame) -> DataFrame:
    """``shard`` of every shard that gives or takes rows; the others need no rewrite."""
    moved = placed.filter("moved")
    return moved.select("shard").unionByName(moved.select(F.col("old_shard").alias("shard"))).distinct()


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the rows of the affected shards, one folder per shard; untouched shards keep their files.

    Rows are matched to their place by id and text; rows that repeat both fill the places of
    their group in turn.
    """
    key = ["_i", "_c"]
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_i"), text_crc32(text_col).alias("_c"))
    # The texts are written with a number each; only these numbers are sorted and meet their places.
    wide, wide_path = write_stage(rows.withColumn("_n", F.monotonically_increasing_id()), "numbered-rows")
    every = placed.select(F.col("doc_id").alias("_i"), F.col("text_crc32").alias("_c"), "shard", "slot")
    # Copies of one row are numbered over all shards, by range partitions: a group of them may hold a third of all rows.
    copies = with_row_index(wide.select(*key, "_n"), ["_n"], key, "_k")
    places = with_row_index(every, ["shard", "slot"], key, "_k").select(F.col("_i").alias("_i2"), F.col("_c").alias("_c2"), F.col("_k").alias("_k2"), "shard", "slot")
    places = places.join(small_side(affected_shards(placed), "affected"), "shard", "left_semi")
    found = copies.join(places, F.col("_i").eqNullSafe(F.col("_i2")) & (F.col("_c") == F.col("_c2")) & (F.col("_k") == F.col("_k2")))
    joined = wide.join(small_side(found.select("_n", "shard", "slot"), "row-places"), "_n")
    files = joined.select(*[F.col(f"_row.`{c}`") for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")
    files.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    drop_stage(docs.sparkSession, wide_path)


def after_rewrite(docs: DataFrame, placed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of :func:`reshard` as the layout now lies: affected shards from their new files, the others as placed."""
    fields = [*[f for f in docs.schema.fields if f.name not in ("shard", "slot")], T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())]
    files = docs.sparkSession.read.schema(T.StructType(fields)).parquet(path)
    old = placed.select("old_shard", "shard", "slot").withColumnsRenamed({"shard": "_s", "slot": "_p"})
    written = files.select(F.col(id_col).alias("doc_id"), size_of(text_col).alias("size"), text_crc32(text_col).alias("text_crc32"), "shard", "slot")
    known = written.join(small_side(old, "old-shards"), (F.col("shard") == F.col("_s")) & (F.col("slot") == F.col("_p")))
    kept = placed.join(small_side(affected_shards(placed), "affected"), "shard", "left_anti")
    columns = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot", (F.col("shard") != F.col("old_shard")).alias("moved")]
    return known.select(*columns).unionByName(kept.select(*columns))
