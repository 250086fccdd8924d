"""Readers with declared schemas: nothing is inferred, and malformed input is an error."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunks import prefix_offsets
from ..operators.pieces import PieceTokenizer
from ..operators.tokenizer import Tokenizer

RAW = "`doc-id` string, text string, category string, script string, language string"
TEXT_FIELDS = ("text", "source_hanzi", "hanzi", "content", "prompt")
PREFERENCES = "prompt string, chosen string, rejected string, source_hanzi string, prompt_ids array<int>, chosen_ids array<int>, rejected_ids array<int>"
CHUNKS = "input_ids array<int>, labels array<int>"
METRICS = "event string, epoch int, step bigint, training_tokens_seen bigint, train_loss double, learning_rate double, tokens_per_second double, validation_loss double, best_loss double, checkpoint_token_target bigint, checkpoint_name string, path string"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = RAW) -> DataFrame:
    """One object a line; blank lines are skipped and bad ones fail the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_split(spark: SparkSession, folder: str, split: str = "train", schema: str = RAW) -> DataFrame:
    """One split of a dataset's folder: its Parquet files, or else its JSON lines, named by the split or in a folder of that name."""
    for kind, read in (("parquet", spark.read.schema(schema).parquet), ("jsonl", lambda *p: read_jsonl(spark, list(p), schema))):
        found = [p for p in (f"{folder}/{split}", *(f"{folder}/{split}*.{kind}",)) if matches(spark, p if p.endswith(kind) else f"{p}/*.{kind}")]
        if found:
            return read(*(p if p.endswith(kind) else f"{p}/*.{kind}" for p in found))
    raise ValueError(f"{folder} has no files of the split {split!r}")


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether a path with wildcards names anything."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON value."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def null_text(df: DataFrame, rule: str = "none_literal", column: str = "text") -> DataFrame:
    """What a null text reads as: the word None, or empty."""
    return df.withColumn(column, F.coalesce(column, F.lit({"none_literal": "None", "empty": ""}[rule])))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_number (from 1) and value of every line of text files; a byte order mark is left out.

    Large files are read by many tasks: a block's lines are counted, and a line's number is its place in its block after the
    lines of the file's blocks before.
    """
    at = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = prefix_offsets(spark.read.text(paths).select(*at, "value"), F.lit(1), "block", "n", by=("path",))
    value = F.when(F.col("offset") == 0, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value"))
    return rows.select("path", (F.col("offset") + 1).alias("line_number"), value.alias("value"))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Stripped lines that are not blank; doc_id numbers them within a file."""
    lines = read_lines(spark, paths).where(~T.is_blank(F.col("value")))
    return lines.select("path", F.col("line_number").alias("doc_id"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("text"))


def read_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """The text files of one folder, not of folders in it."""
    return spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", False).text(path).select(F.col("_metadata.file_path").alias("path"), "value")


def list_folder(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """path, length of the files of one folder, in the order of their paths."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", False).load(path)
    return files.select("path", "length").orderBy("path")


def union_in_order(frames: list[DataFrame]) -> DataFrame:
    """All rows of several tables with the table's place as part, by which they can be put in order."""
    placed = [df.withColumn("part", F.lit(n)) for n, df in enumerate(frames)]
    out = placed[0]
    for df in placed[1:]:
        out = out.unionByName(df)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_items(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, line_number, pos, item."""
    return read_lines(spark, paths).select("path", "line_number", F.posexplode(T.words(F.col("value"))).alias("pos", "item"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """text of each sample, trimmed: of .jsonl objects the first of the text fields that is not blank, else the first string that is not
    blank in the order of the object's keys; of other files the lines. Samples without text are left out; a line that is
    no object is an error."""
    if not path.endswith(".jsonl"):
        return read_documents(spark, path).select("text")
    lines = read_lines(spark, path).where(~T.is_blank(F.col("value")))
    held = F.expr("from_json(value, 'map<string,variant>', map('mode', 'FAILFAST'))")
    texts = F.expr("transform(filter(map_entries(held), e -> schema_of_variant(e.value) = 'STRING'), e -> struct(e.key AS key, CAST(e.value AS string) AS value))")
    rows = lines.select(held.alias("held")).select(F.filter(texts, lambda e: ~T.is_blank(e["value"])).alias("found"))
    named = lambda c: F.get(F.filter("found", lambda e: e["key"] == c), F.lit(0))["value"]
    text = F.coalesce(*map(named, TEXT_FIELDS), F.get("found", F.lit(0))["value"])
    return rows.where(F.size("found") > 0).select(F.regexp_replace(text, r"(?U)^\s+|\s+$", "").alias("text"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of ids; an empty set, a null or a negative id is an error."""
    rows = read_jsonl(spark, path, CHUNKS)
    bad = rows.agg(F.count("*").alias("n"), F.count(F.when(F.col("input_ids").isNull() | F.exists("input_ids", lambda x: x.isNull() | (x < 0)), 1)).alias("bad")).first()
    if not bad.n or bad.bad:
        raise ValueError(f"{path}: {bad.bad} of {bad.n} chunks are not valid")
    return rows


def read_binary_chunks(spark: SparkSession, path: str) -> DataFrame:
    """chunk files of row-major little-endian int32, with the settings of the sidecar <path>.meta.json. path names a folder."""
    meta = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/meta.json", wholetext=True).collect()))
    if meta.get("format") != "int32-chunks" or meta.get("dtype") != "int32":
        raise ValueError(f"{path}: format {meta.get('format')!r} of {meta.get('dtype')!r} is not supported")
    block = int(meta["block_size"])

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for first, content in zip(frame["first"], frame["content"], strict=True):
                ids = np.frombuffer(content, "<i4").reshape(-1, block)
                for at in range(0, len(ids), 4096):
                    part = ids[at : at + 4096]
                    yield pd.DataFrame({"chunk_id": range(first + at, first + at + len(part)), "input_ids": list(part)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first().n
    if size != meta["num_examples"] * block * 4:
        raise ValueError(f"{path}: {size} bytes are not {meta['num_examples']} chunks of {block} ids")
    first = F.regexp_extract("path", r"part-(\d+)\.bin$", 1).cast("long").alias("first")
    return files.select(first, "content").mapInPandas(split, "chunk_id long, input_ids array<int>")


def read_token_dataset(spark: SparkSession, path: str, binary: bool | None = None) -> DataFrame:
    """binary: whether the chunks are; if not given, they are where there is a sidecar."""
    if binary is None:
        binary = exists(spark, f"{path}/meta.json")
    return read_binary_chunks(spark, path) if binary else read_chunks(spark, path)


def read_preferences(spark: SparkSession, path: str) -> DataFrame:
    from ..operators.preferences import require_valid

    rows = read_jsonl(spark, path, PREFERENCES)
    require_valid(rows.withColumn("line", F.monotonically_increasing_id()), "line")
    return rows


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """token, token_id of a JSON object of tokens; ids must run from 0 without gaps or repeats. Small: driver side."""
    found = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()).lstrip("﻿"))
    if sorted(found.values()) != list(range(len(found))):
        raise ValueError(f"{path}: ids must run from 0 without gaps or repeats")
    return spark.createDataFrame(list(found.items()), "token string, token_id int")


def resolve_scores(given: dict | None, stored: dict | None, listed: list | None) -> dict:
    """Scores as given, else as stored beside the vocabulary, else from the metadata's list of {token, frequency}."""
    if given is not None:
        return given
    if stored is not None:
        return stored
    return {x["token"]: float(x["frequency"]) for x in listed or []}


def _json(spark: SparkSession, path: str):
    return json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()).lstrip("\ufeff"))


def read_tokenizer(spark: SparkSession, path: str, **settings) -> Tokenizer | PieceTokenizer:
    """A directory or its vocab.json gives a tokenizer of codes, any other file one of pieces. settings replace stored ones, and a
    tokenizer of pieces, which has one segmentation, ignores them."""
    folder = path.removesuffix("/vocab.json")
    if not exists(spark, f"{folder}/vocab.json"):
        return PieceTokenizer(path)
    stored = _json(spark, f"{folder}/tokenizer_config.json") if exists(spark, f"{folder}/tokenizer_config.json") else {}
    scores = _json(spark, f"{folder}/token_scores.json") if exists(spark, f"{folder}/token_scores.json") else None
    listed = _json(spark, f"{folder}/metadata.json").get("selected") if exists(spark, f"{folder}/metadata.json") else None
    scored = spark.createDataFrame(list(resolve_scores(settings.pop("scores", None), scores, listed).items()), "token string, score double")
    known = read_vocabulary(spark, f"{folder}/vocab.json").join(scored, "token", "left").select("token", "token_id", "score")
    readings = spark.read.schema("character string, syllable string").json(f"{folder}/readings") if exists(spark, f"{folder}/readings") else None
    names = {f.name for f in fields(Tokenizer)} - {"vocabulary", "readings"}
    return Tokenizer(known, readings, **({k: x for k, x in stored.items() if k in names} | settings))


def vocabulary_size(spark: SparkSession, folder: str, wanted: int) -> int:
    """The size of a directory's vocabulary where there is one, else the size that was asked for."""
    return len(_json(spark, f"{folder}/vocab.json")) if exists(spark, f"{folder}/vocab.json") else wanted


if sys.byteorder != "little":
    raise ImportError("binary chunks are little-endian")
