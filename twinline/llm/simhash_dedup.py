"""SimHash near-duplicates: fingerprints cut into blocks, joined where blocks agree, verified by Hamming distance.

Two fingerprints that differ in at most three bits agree in at least three of six blocks, so
every link is found among the fingerprints that share some three blocks. Copies share one
fingerprint and are one node from the start. A bucket of few fingerprints is joined with
itself; a crowded one is matched through flipped bits, whose number is fixed, so the work
follows the number of fingerprints and not the square of a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations, islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..plans.sizing import small_side
from ..plans.stages import drop_stage, write_stage
from .components import connected_components

WORDS = 3  # words of a shingle
BITS = 64
DISTANCE = 3  # bits in which linked fingerprints may differ
BLOCKS = 6  # so that links agree in BLOCKS - DISTANCE of them
SEED = 42
#: A bucket with more fingerprints than this is matched by flips: about so many flips does a member have.
DENSE = 1024
_CHUNK = 1 << 16  # hashes that are unpacked at once


def _hashes(text: str, words: int) -> Iterator[int]:
    # Lower-casing and splitting bytes touch ASCII letters and ASCII white space only.
    w = text.encode("utf-8", "surrogatepass").lower().split()
    runs = zip(*[islice(w, i, None) for i in range(words)]) if len(w) > words else [w] if w else []
    return map(partial(xxhash.xxh64_intdigest, seed=SEED), map(b" ".join, runs))


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's shingles; 0 without words."""
    left, total, counts = _hashes(text or "", words), 0, np.zeros(BITS, np.int64)
    while len(part := np.fromiter(islice(left, _CHUNK), np.uint64)):
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


@F.pandas_udf(T.LongType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """For every choice of blocks that a link may agree in, the bits of those blocks, as signed integers."""
    cuts = np.linspace(0, BITS, blocks + 1).astype(int).tolist()
    each = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(each, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in chosen]


def _mask(table: Column) -> Column:
    return F.get(F.array(*[F.lit(m).cast("long") for m in masks()]), table)


def _flips(fp: Column, free: Column) -> Column:
    """Structs ``(key, near)``: the fingerprint, all within one flipped bit (near) and all with two, among the bits of ``free``."""
    bits = F.filter(F.array(*[F.lit(b - (1 << BITS) if b >> (BITS - 1) else b) for b in (1 << i for i in range(BITS))]),
                    lambda b: b.bitwiseAND(free) != 0)
    one = F.transform(bits, lambda b: F.struct(fp.bitwiseXOR(b).alias("key"), F.lit(True).alias("near")))
    two = F.flatten(F.transform(bits, lambda b, i: F.transform(
        F.slice(bits, i + 2, F.size(bits)), lambda c: F.struct(fp.bitwiseXOR(b).bitwiseXOR(c).alias("key"), F.lit(False).alias("near"))
    )))
    return F.concat(F.array(F.struct(fp.alias("key"), F.lit(True).alias("near"))), one, two)


def _sparse_links(members: DataFrame) -> DataFrame:
    """Links ``(a, b)`` inside buckets, by comparing their members; the distance is tested in the join."""
    x = members.select("table", "block", F.col("fp").alias("a"))
    y = members.select("table", "block", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    return x.join(y, ["table", "block"]).filter((F.col("a") < F.col("b")) & near).select("a", "b")


def _dense_links(members: DataFrame) -> DataFrame:
    """Links that connect what is linked inside crowded buckets, through meeting points of flipped bits.

    A pair at distance three meets where one end has flipped one bit and the other two. Of
    all that meet at a point, those within one flip are linked with everyone there, so one
    of them is joined with each: as many links as members, whose closure is the same.
    """
    own = "table", "block"
    free = F.bitwise_not(_mask(F.col("table")))
    met = members.select(*own, "fp", F.inline(_flips(F.col("fp"), free)))
    hub = met.groupBy(*own, "key").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.count("*").alias("m")).filter("m > 1 AND a IS NOT NULL")
    return met.join(hub, [*own, "key"]).filter("a <> fp").select("a", F.col("fp").alias("b"))


def fingerprint_links(fingerprints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Pairs ``(a, b)`` of the distinct ``fp`` at most ``DISTANCE`` bits apart, enough of them to connect all that are linked.

    In buckets of up to ``dense`` members every pair comes; in larger ones a star for each
    meeting point. No pair further apart comes. An empty table gives an empty result.
    """
    keyed = fingerprints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(len(masks()) - 1))).alias("table"))
    keyed = keyed.withColumn("block", F.col("fp").bitwiseAND(_mask(F.col("table"))))
    sizes = keyed.groupBy("table", "block").agg(F.count("*").alias("m")).filter("m > 1")
    members, path = write_stage(keyed.join(small_side(sizes, "shared-blocks"), ["table", "block"]), "block-members")
    links = _sparse_links(members.filter(F.col("m") <= dense))
    crowded = members.filter(F.col("m") > dense)
    if not crowded.isEmpty():
        links = links.unionByName(_dense_links(crowded))
    found, _ = write_stage(links.distinct(), "fingerprint-links")
    drop_stage(fingerprints.sparkSession, path)
    return found


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """Per row: ``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id``.

    Texts are lower-cased (A-Z only) and cut at ASCII white space; the hashes of all their
    three-word shingles, repeats included, vote on each bit. Documents are linked when their
    fingerprints differ in at most three bits; ``component_id`` is the smallest id that links
    lead to, the document's own included.

    Null, empty and wordless texts have fingerprint 0 and are linked like any other. Rows that
    repeat an id are rows of their own. A null id names a component only where it has no other.
    Other columns are not looked at. An empty table gives an empty result.
    """
    drawn = docs.select(F.col(id_col).alias("doc_id"), _fingerprint(F.col(text_col)).alias("fp"))
    drawn, _ = write_stage(drawn, "fingerprints")
    distinct = drawn.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    distinct, _ = write_stage(distinct, "distinct-fingerprints")
    joined = connected_components(fingerprint_links(distinct.select("fp"), dense))
    joined, _ = write_stage(joined.select(F.col("node").alias("fp"), "comp"), "components")
    linked = distinct.join(joined, "fp")
    names = linked.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = linked.join(names, "comp").select("fp", "component_id").unionByName(
        distinct.filter("n > 1").join(joined, "fp", "left_anti").select("fp", F.col("least").alias("component_id"))
    )
    # The rows of one text may be a third of the table; a side too large to share leaves a join that Spark splits.
    rows = drawn.join(small_side(named, "component-names"), "fp", "left")
    digits = F.lpad(F.lower(F.hex("fp")), BITS // 4, "0")
    return rows.select("doc_id", digits.alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))
