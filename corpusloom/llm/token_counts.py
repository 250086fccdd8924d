"""Token counts of the sections of documents, by character offsets.

Each document is encoded once as a whole. Its tokens' character spans are joined with the spans of its sections: pieces of
the tokenizer's pattern that lie within one section give it all their tokens by a search in the sorted section
starts; only pieces that cross a boundary are looked at token by token. A token that crosses goes by the rule: "most", to
the section that has most of its characters, the earlier one in a tie; "start", to the section where it starts; "end",
to the section where it ends. So the counts of the sections add up to those of the document.

Sections are given as their starting offsets; what stands before the first belongs to it as well. The default sections are
lines, each with the line feed that ends it. Null and empty texts have one empty section without tokens. Rows that share a
doc_id are counted each by itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import column, documents, slices
from ._pretokens import Encoder, encoder, tokenizer_path

RULES = ("most", "start", "end")


def line_starts(text: str) -> np.ndarray:
    """Offsets at which lines start."""
    lengths = np.fromiter(map(len, text.split("\n")), np.int64)
    return np.concatenate([[0], np.cumsum(lengths[:-1] + 1)])


def _owner(starts: np.ndarray, a: int, b: int, rule: str) -> tuple[int, bool]:
    """The section that gets a token with characters a to b, and whether it crosses a boundary."""
    i, j = (max(0, int(np.searchsorted(starts, x, "right")) - 1) for x in (a, max(a, b - 1)))
    if i == j or rule == "start":
        return i, i != j
    if rule == "end":
        return j, True
    edges = [a, *starts[i + 1 : j + 1].tolist(), b]
    return i + int(np.argmax(np.diff(edges))), True


def section_counts(enc: Encoder, text: str, run: tuple[list[str], np.ndarray, np.ndarray], starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """For each section its tokens, and how many of them cross a boundary."""
    pieces, lengths, counts = run
    ends = np.cumsum(lengths)
    at = ends - lengths
    first = np.maximum(np.searchsorted(starts, at, "right") - 1, 0)
    last = np.maximum(np.searchsorted(starts, ends - 1, "right") - 1, 0)
    whole = first == last
    tokens = np.bincount(first[whole], counts[whole], len(starts)).astype(np.int64)
    crossing = np.zeros(len(starts), np.int64)
    for k in np.flatnonzero(~whole):
        for a, b in enc.offsets(pieces[k]):
            owner, crosses = _owner(starts, int(at[k]) + a, int(at[k]) + b, rule)
            tokens[owner] += 1
            crossing[owner] += crosses
    return tokens, crossing


def count_tokens(docs: DataFrame, tokenizer: str, rule: str = "most", sections: Callable[[str], np.ndarray] = line_starts) -> DataFrame:
    """A row for each section of each document: doc_id, section (from 0), start, n_chars, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in slices(batches):
            texts = [x or "" for x in column(batch, "text").to_pylist()]
            made = []
            for text, run in zip(texts, enc.runs(texts), strict=True):
                starts = sections(text)
                tokens, crossing = section_counts(enc, text, run, starts, rule)
                made.append((np.arange(len(starts)), starts, np.diff(starts, append=len(text)), tokens, crossing))
            ids = column(batch, "doc_id").take(pa.array(np.repeat(np.arange(len(made)), [len(m[0]) for m in made])))
            columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*made, strict=True)] if made else [pa.array([], pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"])

    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(count, "doc_id long, section long, start long, n_chars long, n_tokens long, n_crossing long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))
