"""Document quality: fixed rules, then gradient-boosted trees over document statistics.

Each text is reduced to a row of statistics (lengths, symbols, repeated lines and words, case, digits, ...). The trees are
fitted with numpy on a bounded sample of labelled rows and flattened into node arrays: a batch walks down all trees level
by level with array indexing. Features where more can only be worse (repeats, symbols, capitals) carry monotonic
constraints: a split that would raise the score with such a feature isn't taken, and the children's values are kept on
their side of the split's middle, so that the constraint holds for whole trees.

Null or blank texts have no words, fail the rules and are rejected. Without labels of both kinds the rules decide alone.
Rows are judged one by one, so repeated rows get equal verdicts; of labelled rows that share a doc_id the one whose text has the least
hash is fitted on. An empty table gives no rows. Extra columns are passed through by filter_quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import WORDS, column, documents, slices, small_batches, text_bytes, windows

#: At most so many labelled documents are fitted on: those with the smallest hash of doc_id.
SAMPLE = 20_000
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics given to the trees, each with its constraint: -1 where the score may only fall as it grows.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "capital_rate": -1, "digit_rate": 0, "bang_rate": -1,
    "bar_rate": -1, "words_per_line": 0, "distinct_rate": 0, "top_word_rate": -1, "run_rate": -1, "stop_rate": 0, "short_line_rate": 0, "other_rate": 0,
}
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_TAIL = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_CAPITALS, _DIGITS = bytes(range(65, 91)), b"0123456789"
_OTHER = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and x not in b"#*$%&|<>.,!")


def _count(text: bytes, what: bytes) -> int:
    return len(text) - len(text.translate(None, what))


def statistics(text: bytes) -> tuple[list[int], list[float]]:
    """The five base counts and the features of one text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    chars = len(text.translate(None, _TAIL + _SPACE))
    symbols = _count(text, _SYMBOLS)
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    h = WORDS.of(words)
    distinct, counts = np.unique(h, return_counts=True)
    repeat = 0
    if n > 8 and len(distinct) < n:
        runs = windows(h, 8)
        ordered = np.sort(runs)
        again = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(again):
            starts = np.flatnonzero(np.isin(runs, again))
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + 8, -1)
            repeat = int((np.cumsum(edge[:n]) > 0).sum())
    shape = [
        np.log1p(n), chars / n, symbols / n, dup / len(lines), repeat / n, _count(text, _CAPITALS) / chars, _count(text, _DIGITS) / chars, text.count(b"!") / n,
        text.count(b"|") / n, n / len(lines), len(distinct) / n, counts.max() / n, float((h[1:] == h[:-1]).sum()) / n, sum(len(w) < 4 for w in words) / n,
        sum(len(x) < 30 for x in lines) / len(lines), _count(text, _OTHER) / chars,
    ]
    return [n, chars, symbols, dup, repeat], shape


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 20) | (100 * counts[:, 4] > 30 * counts[:, 0])


@dataclass
class Trees:
    """Boosted trees as flat arrays of shape (trees, nodes); node k's children are 2k+1 and 2k+2, a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.feature):
            return np.full(len(x), self.bias)
        trees, at = np.arange(len(self.feature)), np.zeros((len(x), len(self.feature)), np.int64)
        depth = int(np.log2(self.feature.shape[1] + 1)) - 1
        for _ in range(depth):
            f = self.feature[trees, at]
            right = np.take_along_axis(x, np.maximum(f, 0), 1) > self.threshold[trees, at]
            at = np.where(f < 0, at, 2 * at + 1 + right)
        return self.bias + self.value[trees, at].sum(1)


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, l2: float = 1.0) -> Trees:
    """Logistic boosting on histograms of quantile bins."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    nodes, bias = 2 ** (depth + 1) - 1, float(np.log(p / (1 - p)))
    out = Trees(np.full((trees, nodes), -1), np.zeros((trees, nodes)), np.zeros((trees, nodes)), bias)
    margin = np.full(len(y), bias)
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        pending = [(0, np.arange(len(y)), -np.inf, np.inf)]
        while pending:
            k, rows, low, high = pending.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            out.value[t, k] = rate * np.clip(-gs / (hs + l2), low, high)
            best = None
            if k < 2**depth - 1 and len(rows) >= 10:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gl = np.cumsum(np.bincount(binned[rows, j], g[rows], len(c) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[rows, j], h[rows], len(c) + 1))[:-1]
                    left, right = np.clip(-gl / (hl + l2), low, high), np.clip((gl - gs) / (hs - hl + l2), low, high)
                    gain = -(gl * left + 0.5 * (hl + l2) * left**2) - ((gs - gl) * right + 0.5 * (hs - hl + l2) * right**2)
                    gain[(hl < 1) | (hs - hl < 1) | (signs[j] * (right - left) < 0)] = -np.inf
                    i = int(np.argmax(gain))
                    if best is None or gain[i] > best[0]:
                        best = gain[i], j, i, left[i], right[i]
            own = np.clip(-gs / (hs + l2), low, high)
            if best is None or best[0] <= -(gs * own + 0.5 * (hs + l2) * own**2) + 1e-3:
                margin[rows] += out.value[t, k]
                continue
            _, j, i, left, right = best
            out.feature[t, k], out.threshold[t, k] = j, cuts[j][i]
            middle, side = (left + right) / 2, binned[rows, j] > i
            for child, part, falls in ((2 * k + 1, rows[~side], signs[j] < 0), (2 * k + 2, rows[side], signs[j] > 0)):
                bounds = (low, high) if not signs[j] else (middle, high) if falls else (low, middle)
                pending.append((child, part, *bounds))
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = [statistics(x)[1] for x in text_bytes(batch)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "hash"), column(batch, "y"), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "hash", "y", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees | None:
    """Trees fitted on up to `sample` labelled documents; None if they don't have labels of both kinds."""
    small_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # proven bound: 16 bytes a row of the sample
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), "y", "text")
    # of rows that share a doc_id the one whose text has the least hash
    made = rows.mapInArrow(_features, "doc_id long, hash long, y double, x array<double>").groupBy("doc_id").agg(F.min("y").alias("y"), F.min_by("x", "hash").alias("x")).orderBy("doc_id").toArrow()
    y = made["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    x = np.array(made["x"].combine_chunks().flatten().to_numpy()).reshape(len(y), len(FEATURES))
    return fit_trees(x, y, np.array(list(FEATURES.values())))


def _judge(texts: list[bytes], model: Trees | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Base counts, base_failed, the trees' probability of good quality, kept."""
    rows = [statistics(x) for x in texts]
    counts = np.array([r[0] for r in rows], np.int64).reshape(-1, 5)
    failed = base_failed(counts)
    good = 1 / (1 + np.exp(-model.score(np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))))) if model else np.ones(len(rows))
    return counts, failed, good, ~failed & (good >= 0.5)


def quality_verdicts(docs: DataFrame, model: Trees | None) -> DataFrame:
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            counts, failed, good, kept = _judge(text_bytes(batch), model)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *(pa.array(c) for c in counts.T), pa.array(failed), pa.array(good), pa.array(kept)], names=["doc_id", *BASE, "base_failed", "good", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", base_failed boolean, good double, kept boolean")


def filter_quality(docs: DataFrame, model: Trees | None) -> DataFrame:
    """The documents that are kept, with all their columns."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(_judge(text_bytes(batch), model)[3]))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_verdicts(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
