"""Codebooks: which words each code stands for, and messages decoded by them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .counting import first_place, place


def restrict(pairs: DataFrame, message: DataFrame) -> DataFrame:
    """Only pairs whose code occurs in the message."""
    return pairs.join(message.select("code").distinct(), "code", "left_semi")


def codebook(pairs: DataFrame, order: str = "doc_id") -> DataFrame:
    """code, word, cnt and the first place of each pair, from rows (order, pos, code, word)."""
    made = pairs.groupBy("code", "word").agg(F.count("*").alias("cnt"), F.min(place(order)).alias("first"))
    doc, pos = first_place("first")
    return made.select("code", "word", "cnt", doc.alias("first_doc"), pos.alias("first_pos"))


def candidates(book: DataFrame, k: int) -> DataFrame:
    """The k most frequent words of each code, ties by first seen. The limit acts before the shuffle as well."""
    order = W.partitionBy("code").orderBy(F.desc("cnt"), "first_doc", "first_pos")
    return book.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def decode_messages(messages: DataFrame, book: DataFrame) -> DataFrame:
    """id and text of messages (id, pos, code): the best word of each code, <code?> without one, in order, not spaced."""
    best = candidates(book, 1).select("code", F.col("word").alias("best"))
    words = messages.join(best, "code", "left").withColumn("best", F.coalesce("best", F.concat(F.lit("<"), "code", F.lit("?>"))))
    return words.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "best"))), lambda x: x["best"]), "").alias("decoded"))
