"""Merkle manifest of a dataset: a tree of sha256 digests per group, and one over the groups' roots.

A level is one aggregate: every parent gathers its children into ``fanout`` slot columns by
conditional aggregates. Hashing the columns side by side gives the parent; leaving a
child's own column out gives its siblings, so proofs need no join of leaves with leaves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.joins import join_on_groups
from ..plans.row_index import with_row_index
from ..plans.sizing import small_side
from ..plans.stages import write_stage

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    """Lowercase hex sha256 of a string's UTF-8 bytes."""
    return F.sha2(value.cast("binary"), 256)


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: every value as its byte count, a colon and itself; ``-`` for null."""
    texts = [v.cast("string") for v in values]
    framed = [F.concat(F.octet_length(t).cast("string"), F.lit(":"), t) for t in texts]
    return digest(F.concat(*[F.coalesce(f, F.lit("-")) for f in framed]))


def _slots(children: DataFrame, keys: Sequence[str], carried: Sequence[str], fanout: int) -> DataFrame:
    """A row per parent: ``s0 .. s<fanout-1>``, each the struct of the child in that slot or null, and ``hash``."""
    child = F.struct("hash", *carried)
    slot = F.col("idx") % fanout
    spread = [F.max(F.when(slot == i, child)).alias(f"s{i}") for i in range(fanout)]
    parents = children.groupBy(*keys, F.expr(f"idx div {fanout}").alias("idx")).agg(*spread)
    return parents.withColumn("hash", digest(F.concat(*[_hash_in(i) for i in range(fanout)])))


def _hash_in(slot: int) -> Column:
    return F.coalesce(F.col(f"s{slot}.hash"), F.lit(""))


def _children(parents: DataFrame, keys: Sequence[str], carried: Sequence[str], fanout: int) -> DataFrame:
    """The children of parents that carry ``path``: each with its own siblings put before its parent's path."""
    joined = lambda slots: F.concat(F.lit(""), *[_hash_in(i) for i in slots])
    each = [
        F.struct(
            F.lit(i).alias("slot"), F.col(f"s{i}").alias("child"),
            F.struct(joined(range(i)).alias("before"), joined(range(i + 1, fanout)).alias("after")).alias("step"),
        )
        for i in range(fanout)
    ]
    one = parents.select(*keys, "idx", "path", F.explode(F.filter(F.array(*each), lambda x: x["child"].isNotNull())).alias("x"))
    return one.select(
        *keys, (F.col("idx") * fanout + F.col("x.slot")).alias("idx"), F.col("x.child.hash").alias("hash"),
        *[F.col(f"x.child.{c}").alias(c) for c in carried], F.concat(F.array("x.step"), F.col("path")).alias("path"),
    )


def _climb(leaves: DataFrame, keys: Sequence[str], carried: Sequence[str], fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """The parents of every level, lowest first, and the top node ``(keys, hash)`` of every group.

    ``leaves`` holds ``idx`` (dense from 0 in a group), ``total`` (the group's nodes), ``hash``.
    Groups differ in height: a group with one node left is at its top and climbs no more.
    Levels shrink by ``fanout``; each is written, as the next level and the proofs read it.
    """
    levels, nodes, extra, tops = [], leaves, list(carried), []
    while True:
        tops.append(nodes.filter("total = 1").select(*keys, "hash"))
        wide = nodes.filter("total > 1")
        if wide.isEmpty():
            break
        parents = _slots(wide, [*keys, "total"], extra, fanout)
        parents = parents.withColumn("total", F.expr(f"(total + {fanout - 1}) div {fanout}"))
        level, _ = write_stage(parents, "merkle-level")
        levels.append(level)
        nodes, extra = level.select(*keys, "idx", "total", "hash"), []
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, top


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, keys: Sequence[str], carried: Sequence[str], fanout: int) -> DataFrame:
    """Every leaf with ``path``: the hashes before and after its own at each level, from the leaf upwards.

    ``tops`` gives ``(keys, path)``: what follows above the group's top node.
    """
    open_ = None  # nodes of the level above that carry their path
    for depth in range(len(levels) - 1, -1, -1):
        level = levels[depth]
        started = join_on_groups(level.filter("total = 1"), small_side(tops, "merkle-tops"), keys)
        if open_ is not None:
            inner = join_on_groups(level.filter("total > 1"), open_.select(*keys, "idx", "path"), [*keys, "idx"])
            started = started.unionByName(inner)
        open_ = _children(started, keys, carried if depth == 0 else [], fanout)
    alone = join_on_groups(leaves.filter("total = 1"), small_side(tops, "merkle-tops"), keys).select(*keys, "idx", "hash", *carried, "path")
    return alone if open_ is None else alone.unionByName(open_)


def _fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda h, step: digest(F.concat(step["before"], h, step["after"])))


def manifest(
    docs: DataFrame,
    tampered: Column,
    fields: Sequence[str] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    text: str = "text",
    fanout: int = FANOUT,
) -> DataFrame:
    """Per row: ``order``, ``leaf, subroot, root, proof_sha256, folded_root, verified``.

    A leaf is the digest of the row's ``fields``. Per ``group`` value the leaves, by ``order``,
    are hashed in runs of ``fanout`` until one node is left, its subroot; subroots, by group
    value, likewise give the root. ``proof_sha256`` digests a leaf's siblings from the bottom
    to the root. ``folded_root`` climbs with these siblings from the leaf that the row has with
    ``tampered`` as its text; ``verified`` tells whether that is the root.

    Nulls are fields (``-``), a null group is a group and comes first, null ids come first
    in their group. Rows with equal ids are told apart by their leaves, so equal rows take
    neighbouring places and the result has one row for each. No text is cut. Columns beyond
    ``fields`` are not looked at; ``leaf`` and the other result names may be columns of
    ``docs``. An empty table gives an empty result.
    """
    values = {c: F.col(c) for c in fields}
    plain, changed = leaf_digest(list(values.values())), leaf_digest(list((values | {text: tampered}).values()))
    rows = docs.select(
        F.col(group).alias("grp"), F.col(order).alias("key"), plain.alias("hash"),
        F.when(~F.col(text).eqNullSafe(tampered), changed).alias("other"),
    )
    # Written before it is placed: finding the ranges reads its input once more, and this copy has no texts.
    narrow, _ = write_stage(rows, "leaves")
    leaves = with_row_index(narrow, ["key", "hash"], within=["grp"], out="idx", total="total")
    carried = ["key", "other"]
    levels, subroots = _climb(leaves, ["grp"], carried, fanout)
    named, _ = write_stage(subroots, "subroots")
    tops = with_row_index(named, ["grp"], out="idx", total="total").withColumn("all", F.lit(0))
    upper, root = _climb(tops, ["all"], ["grp"], fanout)
    above = _descend(tops, upper, root.select("all", F.expr(f"CAST(array() AS array<struct<before: string, after: string>>)").alias("path")), ["all"], ["grp"], fanout)
    above = above.join(F.broadcast(root.select("all", F.col("hash").alias("root"))), "all")  # one row
    above, _ = write_stage(above.select("grp", F.col("hash").alias("subroot"), "root", "path"), "subroot-paths")
    proven = _descend(leaves, levels, above.select("grp", "path"), ["grp"], carried, fanout)
    full = join_on_groups(proven, small_side(above.drop("path"), "roots"), ["grp"])
    siblings = F.array_join(F.transform("path", lambda x: F.concat(x["before"], x["after"])), "")
    folded = full.withColumn("folded_root", _fold(F.coalesce("other", "hash"), F.col("path")))
    return folded.select(
        F.col("key").alias(order), F.col("hash").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def lowered_for_a_third(text: Column, order: Column) -> Column:
    """The text with A-Z lower-cased where 3 divides the crc32 of the decimal id, as it is elsewhere."""
    chosen = F.crc32(order.cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(text, _UPPER, _LOWER)).otherwise(text)
