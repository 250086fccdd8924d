"""Writers of lines, JSON, chunks and vocabularies."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import fields

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.chunks import packing_statistics, prefix_offsets
from ..operators.tokenizer import Tokenizer
from ..plans.staging import arrow_uri


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a line; null fields are left out."""
    df.write.mode(mode).json(path)


def write_lines(df: DataFrame, path: str, column: str, *order: str) -> None:
    """Lines in order: parts of ranges of the order, sorted within."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col(column).alias("value")).write.text(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def _put(df: DataFrame, path: str, content: str) -> None:
    """A small file through Hadoop's file systems, so that any store Spark reaches will do."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_json(df: DataFrame, path: str, value) -> None:
    """A JSON value of bounded size, keys sorted, as one file."""
    _put(df, path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True) + "\n")


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """vocab.json in order of ids and token_scores.json in order of tokens. Vocabularies are bounded by their size."""
    rows = vocabulary.orderBy("token_id").collect()
    _put(vocabulary, f"{path}/vocab.json", json.dumps({r.token: r.token_id for r in rows}, ensure_ascii=False, indent=2) + "\n")
    write_json(vocabulary, f"{path}/token_scores.json", {r.token: r.score for r in rows if r.score is not None})


METADATA = "metadata.json"
# Which of the fixed tokens has which part.
SPECIAL_PARTS = {"pad_token": "<pad>", "unk_token": "<unk>", "bos_token": "<s>", "eos_token": "</s>", "mask_token": "<mask>"}


def write_tokenizer(tokenizer: Tokenizer, path: str, **metadata) -> None:
    """A tokenizer's directory: vocabulary, scores, special tokens, settings and metadata, each one file; read by read_tokenizer."""
    v = tokenizer.vocabulary
    write_vocabulary(v, path)
    write_json(v, f"{path}/special_tokens_map.json", SPECIAL_PARTS)
    settings = {f.name: getattr(tokenizer, f.name) for f in fields(tokenizer) if f.name not in ("vocabulary", "readings")}
    write_json(v, f"{path}/tokenizer_config.json", settings | SPECIAL_PARTS)
    write_json(v, f"{path}/{METADATA}", {"vocab_size": v.count(), **metadata})
    if tokenizer.readings is not None:
        tokenizer.readings.select("character", "syllable").write.json(f"{path}/readings")


def write_cases(cases: DataFrame, path: str) -> None:
    """Distinct cases as JSON lines in the order of character, pinyin and tone."""
    order = ("character", "pinyin", "tone")
    write_lines(cases.withColumn("_line", F.to_json(F.struct(*cases.columns))), path, "_line", *order)


def write_packed(df: DataFrame, path: str, lines: Column, packed: Column, *order: str, dry_run: bool = False) -> dict:
    """Packed lines in order, and their statistics; a dry run gives the statistics alone."""
    if not dry_run:
        write_lines(df.select(*order, F.posexplode(packed).alias("_n", "_line")), path, "_line", *order, "_n")
    return packing_statistics(df, lines, packed).first().asDict()


def write_chunks(chunks: DataFrame, path: str, block: int, stride: int, kind: str = "jsonl", **settings) -> None:
    """Chunks as JSON lines or in binary form, as kind says."""
    if kind not in ("jsonl", "bin"):
        raise ValueError(f"kind must be jsonl or bin, not {kind!r}")
    if kind == "bin":
        write_binary_chunks(chunks, path, block, stride, **settings)
    else:
        write_jsonl(chunks, path)


def write_binary_chunks(chunks: DataFrame, path: str, block: int, stride: int, **settings) -> dict:
    """chunk_id, input_ids as .bin files named by their first chunk, in row-major little-endian int32, and meta.json.

    Files are written by the tasks through pyarrow's file systems under names of their own attempt and put in place by the
    driver, so a lost or repeated task leaves nothing behind.
    """
    spark, made = chunks.sparkSession, f"_parts-{uuid.uuid4().hex}"
    target = arrow_uri(spark, path)

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        out = None
        for frame in frames:
            if not len(frame):
                continue
            if out is None:
                system, base = fs.FileSystem.from_uri(target)
                system.create_dir(f"{base}/{made}", recursive=True)
                first, n, top = int(frame["offset"].iloc[0]), 0, -1
                name = f"{made}/{first}-{TaskContext.get().taskAttemptId()}.bin"
                out = system.open_output_stream(f"{base}/{name}")
            ids = np.stack(frame["input_ids"].to_numpy())
            if ids.min() < 0 or ids.max() >= 2**31:
                raise ValueError("an id is out of the range from 0 to 2**31 - 1")
            out.write(ids.astype("<i4").tobytes())
            n, top = n + len(ids), max(top, int(ids.max()))
        if out is not None:
            out.close()
            yield pd.DataFrame({"name": [name], "first": [first], "n": [n], "top": [top]})

    placed = prefix_offsets(chunks.select("chunk_id", F.col("input_ids").cast("array<long>").alias("input_ids")), F.lit(1), "chunk_id")
    dealt = placed.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id").select("offset", "input_ids")
    files = dealt.mapInPandas(write, "name string, first long, n long, top long").collect()  # a row for each file
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    system = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)
    for f in files:
        system.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{f.name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/part-{f.first}.bin"))
    system.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{made}"), True)
    meta = {"format": "int32-chunks", "dtype": "int32", "num_examples": sum(f.n for f in files), "block_size": block, "stride": stride, "max_token_id": max((f.top for f in files), default=-1), **settings}
    write_json(chunks, f"{path}/meta.json", meta)
    return meta
