"""Encoding and decoding with a SentencePiece model file, loaded once per worker."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_MODELS: dict = {}


def _model(path: str):
    if path not in _MODELS:
        import sentencepiece

        _MODELS[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _MODELS[path]


def encode(text: Column, path: str) -> Column:
    """Ids of a text; null stays null."""

    def run(texts: pd.Series) -> pd.Series:
        known = texts.notna()
        out = pd.Series([None] * len(texts), dtype=object)
        out[known.to_numpy()] = pd.Series(_model(path).encode(texts[known].tolist(), num_threads=1), dtype=object).to_numpy()
        return out

    return F.pandas_udf(run, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of ids; no ids decode to the empty text."""

    def run(rows: pd.Series) -> pd.Series:
        known = rows.notna()
        out = pd.Series([None] * len(rows), dtype=object)
        out[known.to_numpy()] = pd.Series(_model(path).decode([list(map(int, x)) for x in rows[known]], num_threads=1), dtype=object).to_numpy()
        return out

    return F.pandas_udf(run, "string")(ids)


@dataclass(frozen=True)
class PieceTokenizer:
    """A SentencePiece model file with the calls of the tokenizer of codes."""

    path: str

    def using(self, **settings) -> "PieceTokenizer":
        """A model has one segmentation: settings change nothing."""
        return self

    def ids(self, df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        return df.select(key, encode(F.coalesce(F.col(text), F.lit("")), self.path).alias("ids"))

    def decode(self, df: DataFrame, ids: str = "ids", key: str = "doc_id") -> DataFrame:
        return df.select(key, decode(F.col(ids), self.path).alias("text"))
