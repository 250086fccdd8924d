"""A corpus pipeline: quality rules, line dedup, near-dedup, mixing of sources, and encoding to pieces.

Each stage works on all that the one before it kept, written as Parquet and read again. SQL can express neither the trees, the
draws nor the merges, so there is no SQL for the whole; the stages are tested against brute-force versions.

Every stage gives no rows for an empty table and passes extra columns through, but for the last, which returns what it says.
Nulls, blank texts, repeats and ties:

- quality rules: null, blank and short texts fail and go; repeated rows get equal verdicts.
- line dedup: null, empty and blank texts have no lines to lose and stay; documents of which nothing is left go. Rows equal in
  doc_id and text are one document here and keep the same lines; of equal or nearly equal lines the first by doc_id (nulls
  first), text's hash and position stays.
- near dedup: the smallest doc_id of each group stays, nulls last, then the least hash of the text; rows equal in doc_id and text are
  one document; null and blank texts are linked with nothing and all stay.
- mixing: null is a source of its own; texts without words are taken by the whole part of their source's ratio; rows equal in doc_id,
  source and size are taken alike.
- piece encoding: null texts have no ids; rows equal in doc_id and text are numbered and have skips of their own.

Near copies mostly reach near dedup with few lines in common: line dedup has taken the lines that they share with what they
are copies of. What is left of them are the lines that differ, and these are not near copies of anything.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm._common import documents, scoped, staged
from corpusloom.llm._pretokens import tokenizer_path
from corpusloom.llm.line_dedup import DROPPED, LINES, dedup_lines
from corpusloom.llm.minhash import keep_one
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.quality import filter_quality, fit_quality
from corpusloom.llm.sentencepiece_codec import encode_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return filter_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents of which nothing is left."""
    out = dedup_lines(docs).where((F.col(LINES) > F.col(DROPPED)) | (F.col(DROPPED) == 0)).drop(LINES, DROPPED)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays."""
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mix_sources(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and ids of each document of the mix; copies of one document are numbered and so differ."""
    equal = W.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
    numbered = docs.select("doc_id", "lang", "source", "text", (F.row_number().over(equal) - 1).alias("copy"))
    encoded = encode_documents(numbered, tokenizer_path("piece_bpe_32k.model"), copy="copy")
    return encoded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("piece encoding", piece_encoding)]
ORACLE_SQL = None


@scoped
def _written(spark: SparkSession, docs: DataFrame, sf_dir: str, name: str, stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> DataFrame:
    return staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))


@scoped
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = _written(spark, docs, sf_dir, name, stage)
    return STAGES[-1][1](spark, docs, sf_dir)
