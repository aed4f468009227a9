from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from twinline.functions.text import normalize
from twinline.operators import pairs as P
from twinline.operators.map_lines import map_lines
from twinline.operators.runlog import token_weighted_loss
from twinline.sources import lines as L, pairs as SP
from twinline.streaming.lines import stream_map_lines
from twinline.streaming.runlog import latest_loss, stream_running_loss

PAIRS = "pair_id long, split string, src string, tgt string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(
        [(2, "train", " b ", "B"), (1, "train", "a", "A\nA2 "), (3, "validation", "v", "V"), (4, "test", "t", "")], PAIRS
    )


def test_read_pairs_prunes_by_split(spark, base, tmp_path):
    path = str(tmp_path / "p")
    base.write.partitionBy("split").parquet(path)
    read = SP.read_pairs(spark, path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, base.collect()))
    plan = read.filter("split = 'test'").select("src")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "tgt" not in plan.split("ReadSchema")[1]


def test_read_pairs_from_json(spark, base, tmp_path):
    path = str(tmp_path / "p")
    base.select("pair_id", "split", F.col("src").alias("en"), F.col("tgt").alias("de")).write.json(path)
    got = SP.read_pairs(spark, path, "json", "en", "de")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, base.collect()))


def test_extra_sources(spark, tmp_path):
    path = str(tmp_path / "x")
    spark.createDataFrame(
        [(1, " one ", "eins"), (2, "  ", "zwei"), (3, "three", "\xa0"), (4, "four", "vier "), (5, "five", "fünf")],
        "pair_id long, en string, de string",
    ).select("pair_id", F.struct("en", "de", F.lit("big").alias("unused")).alias("translation")).write.parquet(path)
    registry = {"books": SP.ExtraSource(path)}
    read = lambda cap=None: [(r.pair_id, r.src, r.tgt) for r in SP.read_extra(spark, registry, "books", cap).orderBy("pair_id").collect()]
    assert read() == [(1, "one", "eins"), (4, "four", "vier"), (5, "five", "fünf")]
    assert read(2) == read()[:2]
    assert read(0) == read()
    with pytest.raises(ValueError, match="nowhere"):
        SP.read_extra(spark, registry, "nowhere")
    plan = SP.read_extra(spark, registry, "books")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan.split("ReadSchema")[1]


def test_merge_touches_train_only(spark, base):
    extra = spark.createDataFrame([(1, "test", "x", "X"), (1, "test", "x", "X")], PAIRS)
    merged = P.merge_train_extra(base, extra)
    counts = {(r.split, r.origin): r.n_pairs for r in P.split_counts(merged).collect()}
    assert counts == {
        ("train", "base"): 2, ("train", "extra"): 2, ("train", "all"): 4, ("validation", "base"): 1,
        ("validation", "all"): 1, ("test", "base"): 1, ("test", "all"): 1,
    }


def test_corpus_file(spark, base, tmp_path):
    extra = spark.createDataFrame([(0, "train", "x", "X")], PAIRS)
    path, count = L.write_corpus(P.merge_train_extra(base, extra), str(tmp_path / "c"))
    assert count == 6
    numbered = L.read_numbered_lines(spark, path).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in numbered] == list(enumerate(["a", "A", "A2", "b", "B", "x", "X"], 1))
    path, count = L.write_corpus(base, str(tmp_path / "c2"), ("test", "train"))
    assert [r.line for r in L.read_numbered_lines(spark, path).orderBy("line_no").collect()] == ["t", "", "a", "A", "A2", "b", "B"]


def test_read_lines(spark, tmp_path):
    (tmp_path / "f.txt").write_text(" a \n\n\tb\r\n\xa0\nc\rd", encoding="utf-8", newline="")
    assert sorted(r.line for r in L.read_lines(spark, str(tmp_path / "f.txt")).collect()) == ["a", "b", "c", "d"]


@pytest.mark.parametrize("split_bytes", ["134217728", "64"])
def test_numbered_lines_over_many_blocks(spark, tmp_path, split_bytes):
    text = "\n".join(("" if i % 9 == 0 else f"line {i} " + "x" * (i % 40)) for i in range(500)) + "\nv\vw\fx\x1cy z\n\nend\n"
    (tmp_path / "f.txt").write_text(text, encoding="utf-8", newline="")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], split_bytes)
    spark.conf.set(names[1], "1")
    try:
        got = L.read_numbered_lines(spark, str(tmp_path / "f.txt")).orderBy("line_no").collect()
    finally:
        for n, v in zip(names, old):
            spark.conf.set(n, v)
    assert [(r.line_no, r.line) for r in got] == list(enumerate(text.splitlines(), 1))


def test_translations_keep_their_lines(spark, tmp_path):
    lines = ["one two", "", "  three ", "   ", "four"]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string").repartition(4)
    mapped = map_lines(df, lambda s: s.upper() + "!")
    path = L.write_translations(mapped, str(tmp_path / "t"))
    got = L.read_numbered_lines(spark, path).orderBy("line_no").collect()
    assert [r.line for r in got] == ["ONE TWO!", "", "THREE!", "", "FOUR!"]


def test_line_stream_equals_batch_and_resumes(spark, tmp_path):
    source, sink, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    operator = lambda df: df.select(normalize(F.col("line")).alias("line"))
    (source / "a.txt").write_text(" A b\n\n C\n", encoding="utf-8")
    run = lambda: stream_map_lines(spark, str(source), sink, state, operator, max_files_per_trigger=1).awaitTermination()
    run()
    time.sleep(1.1)  # a new file needs a later modification time
    (source / "b.txt").write_text("D\n", encoding="utf-8")
    run()
    run()  # nothing new: nothing is written twice
    batch = operator(L.read_lines(spark, str(source)))
    assert sorted(r.line for r in spark.read.parquet(sink).collect()) == sorted(r.line for r in batch.collect()) == ["a b", "c", "d"]


def test_running_loss_stream_ends_at_the_batch_result(spark, tmp_path):
    source, schema = str(tmp_path / "log"), "epoch int, batch_idx int, loss double, n_tokens int"
    for part in range(3):
        rows = [(e, part * 10 + i, 1.0 + i / 7 + e, (i + part) % 4) for e in (1, 2) for i in range(10)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(FileNotFoundError):
        latest_loss(spark, str(tmp_path / "out"))
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    stream_running_loss(log, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.epoch: (round(r.mean_loss, 9), r.n_tokens) for r in latest_loss(spark, str(tmp_path / "out")).collect()}
    batch = token_weighted_loss(spark.read.parquet(source))
    assert got == {r.epoch: (round(r.mean_loss, 9), r.n_tokens) for r in batch.collect()}
    # Three micro-batches, and a read still meets one row per epoch.
    kept = sorted((tmp_path / "out").glob("version=*"))
    assert [k.name for k in kept] == ["version=1", "version=2"]
    assert spark.read.parquet(str(kept[-1])).count() == 2
