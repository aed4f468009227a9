"""Saving, loading and reusing a vocabulary: versioned parquet tables, and the usual JSON file.

Every save writes a version of its own, ``<path>/versions/<name>``, and then publishes it by
creating one empty file, ``<path>/published/<number>_<name>_<settings>``. The version with the
highest number is the current one, so a reader sees a whole version or the one before it.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.text import SPECIAL_TOKENS
from ..operators.vocab import Vocabulary, check_special_ids, train_bpe, word_counts
from ..plans.stages import path_exists

VOCAB_SCHEMA = "id int, token string"
MERGES_SCHEMA = "rank int, left_id int, right_id int, new_id int"
ANY = "any"  # settings of a vocabulary that was saved without them


def _fs(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _published(spark: SparkSession, path: str) -> list[tuple[int, str, str]]:
    """``(number, version, settings)`` of everything published, oldest first."""
    fs, folder = _fs(spark, f"{path}/published")
    if not fs.exists(folder):
        return []
    names = [status.getPath().getName() for status in fs.listStatus(folder)]
    return sorted((int(n), version, settings) for n, version, settings in (name.split("_") for name in names))


def save_vocab(vocabulary: Vocabulary, path: str, settings: str = ANY) -> str:
    """Publish the vocabulary as the newest version at ``path``; earlier versions stay."""
    spark = vocabulary.vocab.sparkSession
    version = uuid.uuid4().hex
    vocabulary.merges.write.parquet(f"{path}/versions/{version}/merges")
    vocabulary.vocab.write.parquet(f"{path}/versions/{version}/vocab")
    number = max((n for n, *_ in _published(spark, path)), default=0) + 1
    fs, marker = _fs(spark, f"{path}/published/{number:08d}_{version}_{settings}")
    fs.mkdirs(marker.getParent())
    fs.createNewFile(marker)
    return path


def vocab_exists(spark: SparkSession, path: str) -> bool:
    return bool(_published(spark, path))


def load_vocab(spark: SparkSession, path: str) -> Vocabulary:
    """The newest published version; FileNotFoundError when there is none."""
    published = _published(spark, path)
    if not published:
        raise FileNotFoundError(f"no vocabulary at {path!r}; train and save one first")
    version = f"{path}/versions/{published[-1][1]}"
    vocabulary = Vocabulary(
        spark.read.schema(VOCAB_SCHEMA).parquet(f"{version}/vocab"), spark.read.schema(MERGES_SCHEMA).parquet(f"{version}/merges")
    )
    check_special_ids(vocabulary.vocab)
    return vocabulary


def learning_settings(lines: DataFrame, vocab_size: int, min_frequency: int, line: str = "line", corpus: bool = False) -> str:
    """A short name of what a vocabulary is learned with; with ``corpus``, of the lines as well (in any order)."""
    parts = [vocab_size, min_frequency]
    if corpus:
        parts += list(lines.agg(F.count(line), F.sum(F.xxhash64(line).cast("decimal(38,0)"))).first())
    return hashlib.sha256(":".join(map(str, parts)).encode()).hexdigest()[:16] + ("c" if corpus else "s")


def get_or_train_vocab(
    lines: DataFrame,
    path: str,
    force: bool = False,
    vocab_size: int = 16_000,
    min_frequency: int = 2,
    line: str = "line",
    follow_corpus: bool = False,
) -> Vocabulary:
    """Load the vocabulary at ``path``; train and publish it if absent, forced or learned with other settings.

    Settings are the size and the least frequency; with ``follow_corpus`` also the lines, at
    the price of reading them. A vocabulary that was saved without settings is always loaded.
    """
    spark = lines.sparkSession
    settings = learning_settings(lines, vocab_size, min_frequency, line, follow_corpus)
    published = _published(spark, path)
    if force or not published or published[-1][2] not in (ANY, settings):
        save_vocab(train_bpe(word_counts(lines, line), vocab_size, min_frequency), path, settings)
    return load_vocab(spark, path)


# ---- the JSON file that tokenizer packages share -------------------------------------------


def export_json(vocabulary: Vocabulary, path: str) -> str:
    """Write the vocabulary as one JSON file: lower-casing, word cutting, merges, and SOS and EOS around a text.

    A vocabulary is bounded by its size, not by the data, so the driver writes it.
    """
    tokens = vocabulary.tokens()
    special = lambda name: {"SpecialToken": {"id": name, "type_id": 0}}
    text = lambda name: {"Sequence": {"id": name, "type_id": 0}}
    framed = lambda name: [special("[SOS]"), text(name), special("[EOS]")]
    content = {
        "version": "1.0",
        "truncation": None,
        "padding": None,
        "added_tokens": [
            {"id": i, "content": t, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
            for i, t in enumerate(SPECIAL_TOKENS)
        ],
        "normalizer": {"type": "Lowercase"},
        "pre_tokenizer": {"type": "Whitespace"},
        "post_processor": {
            "type": "TemplateProcessing",
            "single": framed("A"),
            "pair": framed("A") + framed("B"),
            "special_tokens": {t: {"id": t, "ids": [SPECIAL_TOKENS.index(t)], "tokens": [t]} for t in ("[SOS]", "[EOS]")},
        },
        "decoder": None,
        "model": {
            "type": "BPE", "dropout": None, "unk_token": "[UNK]", "continuing_subword_prefix": None, "end_of_word_suffix": None,
            "fuse_unk": False, "byte_fallback": False, "ignore_merges": False,
            "vocab": {t: i for i, t in enumerate(tokens)},
            "merges": [[tokens[left], tokens[right]] for left, right, _ in vocabulary.merge_rules()],
        },
    }
    fs, target = _fs(vocabulary.vocab.sparkSession, path)
    out = fs.create(target, True)
    try:
        out.write(json.dumps(content, ensure_ascii=False).encode())
    finally:
        out.close()
    return path


def import_json(spark: SparkSession, path: str) -> Vocabulary:
    """The vocabulary of such a file; FileNotFoundError if there is none, RuntimeError on other special ids."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"no vocabulary file at {path!r}")
    model = json.loads(spark.read.text(path, wholetext=True).first()[0])["model"]
    ids = model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    vocabulary = Vocabulary(
        spark.createDataFrame(sorted((i, t) for t, i in ids.items()), VOCAB_SCHEMA),
        spark.createDataFrame([(rank, ids[a], ids[b], ids[a + b]) for rank, (a, b) in enumerate(merges)], MERGES_SCHEMA),
    )
    check_special_ids(vocabulary.vocab)
    return vocabulary
