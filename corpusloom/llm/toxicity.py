"""Toxicity of documents through a noisy channel.

Writers hide words by look-alike digits and symbols, by dots or spaces between letters, and by repeated letters. A word that
shows signs of this is a lattice of what each character may stand for; a Viterbi search under a character trigram model
finds the likeliest spelling. Two models decode: one counted over all training documents, and one counted over the
words that labels mark as toxic, since a hidden word is drawn from these. The evidence of a word is the lower
confidence bound of the log odds of its spelling and beginnings between toxic and other labelled documents, of whichever
decoding has more; a logistic regression over a document's evidence gives the score.

Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0 and from at most `sample` of them, those with the
smallest hash of doc_id; the character counts cover all such documents. Only texts enter a score. Null and empty
texts have no evidence and get the score of none. Words are read as Latin letters, accents left out: other scripts have no
spelling here and give no evidence. The sum of a document's evidence counts up to 50. A null doc_id counts as held out. Without labels of both kinds every
score is 0. Rows that share a doc_id are scored each by itself; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, documents, slices

#: At most so many labelled documents are learned from.
SAMPLE = 10_000
#: Least lower bound of a feature's log odds, and how many standard errors it is below the estimate. A feature must also have
#: a likelihood ratio that is not expected by chance among as many features as there are.
LEAST, ERRORS = 1.5, 1.645
#: What look-alikes stand for, and characters that may only part letters.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h"}
GAPS = frozenset(".-_*~'’·,/\\^")
N = 27
SUMMARY = 5
_SINGLES = re.compile(r"(?:^|\s)\S\s\S\s\S(?:\s|$)")
_WIDE = re.compile(r"\s{2,}|\n")
_REPEAT = re.compile(r"(.)\1+")
_TRIPLE = re.compile(r"(.)\1\1")
_EDGES = re.compile(r"^(?:[^\w@$!|+(*#]|([^\w\s])\1+)+|(?:[^\w@$|+*#]|([^\w\s])\2+|[!.,;:?])+$")


@cache
def letter(c: str) -> int:
    """1 to 26 for a letter, accents left out; 0 for anything else."""
    base = unicodedata.normalize("NFKD", c.lower())[:1]
    return ord(base) - 96 if "a" <= base <= "z" else 0


@cache
def _table() -> np.ndarray:
    return np.array([letter(chr(c)) for c in range(0x250)], np.int64)


def trigram_counts(texts: list[str]) -> np.ndarray:
    codes = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "replace"), np.uint32)
    s = _table()[np.where(codes < 0x250, codes, 0)]
    return np.bincount(s[:-2] * N * N + s[1:-1] * N + s[2:], minlength=N**3)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b), smoothed by shorter contexts; a first letter sees only the boundary before it."""
    c3 = counts.reshape(N, N, N).astype(float)
    c2 = c3.sum(0)
    p1 = (c2.sum(0) + 1) / (c2.sum() + N)
    p2 = (c2 + 4 * p1) / (c2.sum(1, keepdims=True) + 4)
    p3 = (c3 + 4 * p2) / (c3.sum(2, keepdims=True) + 4)
    return np.log(np.concatenate([p3, p2[None]]))  # row N: no letter two places back


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """For each stretch of the word what it may stand for, with the log probability of the channel."""
    out, i = [], 0
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        run, options = j - i, []
        if c in LOOKS:
            options += [(x * k, -0.7 * k) for x in LOOKS[c] for k in {1, run if run < 3 else 1}]
        if c in GAPS or c in "|!":
            options.append(("", -0.7 if c in GAPS else -2.5))
        if letter(c):
            x = chr(96 + letter(c))
            options += [(x, 0.0)] if run == 1 else [(x, -0.7), (x * 2, -0.7 if run > 2 else -0.1)]
        out.append(options or [("", -2.0)])
        i = j
    return out


def viterbi(word: str, model: np.ndarray) -> str:
    best: dict[tuple[int, int], tuple[float, str]] = {(N, 0): (0.0, "")}
    for options in lattice(word):
        new: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (p, done) in best.items():
            for text, q in options:
                x, y, total = a, b, p + q
                for c in text:
                    k = ord(c) - 96
                    total += model[x, y, k]
                    x, y = (0 if x == N else y), k
                if (x, y) not in new or total > new[x, y][0]:
                    new[x, y] = total, done + text
        best = new
    return max((p + model[a, b, 0], done) for (a, b), (p, done) in best.items())[1]


def hidden(word: str) -> bool:
    """Whether a word's characters or repeats may hide its spelling: letters beside other characters, letters three times in a row,
    or look-alikes alone, symbols among them. Numbers are taken as numbers, and a star needs letters beside it."""
    if any(map(str.isalpha, word)):
        return not word.isalpha() or bool(_TRIPLE.search(word))
    return "*" not in word and sum(c in LOOKS for c in word) > 1 and any(c in LOOKS and not c.isdigit() for c in word)


def plain(word: str) -> str:
    return "".join(chr(96 + k) for k in map(letter, word) if k)


def words_of(text: str) -> list[str]:
    """The lower-case words; runs of three and more single characters are also put together. A wider gap or a new line ends a run."""
    text = text.lower()
    words = text.split()
    if _SINGLES.search(text):
        for stretch in _WIDE.split(text):
            run: list[str] = []
            for w in [*stretch.split(), ""]:
                if len(w) == 1:
                    run.append(w)
                    continue
                if len(run) >= 3:
                    whole = "".join(run)
                    words += [whole, whole[1:], whole[:-1]]  # a word of one letter may stand beside
                run = []
    return words


def features(spelling: str) -> list[str]:
    return [spelling, *(f"{spelling[:k]}-" for k in (4, 5, 6) if len(spelling) > k)] if len(spelling) > 2 else []


@dataclass
class Decoder:
    """Spellings of words and, once there is a lexicon, their evidence; both are kept for the words met last."""

    common: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    toxic: np.ndarray | None = None
    limit: int = 300_000
    kept: dict = field(default_factory=dict, repr=False)

    def spellings(self, word: str) -> set[str]:
        word = _EDGES.sub("", word)
        spelled = plain(word)
        found = {spelled, _REPEAT.sub(r"\1", spelled)}
        if not hidden(word):
            return found
        found.add(viterbi(word, self.common))
        if self.toxic is not None:
            found.add(viterbi(word, self.toxic))
        return found

    def evidence(self, word: str) -> float:
        e = self.kept.get(word)
        if e is None:
            if len(self.kept) >= self.limit:
                self.kept.clear()
            e = self.kept[word] = max((self.lexicon.get(f, 0.0) for s in self.spellings(word) for f in features(s)), default=0.0)
        return e

    def summary(self, text: str) -> list[float]:
        """Of the different words with evidence: the most, its square, how many, the sum, and how many in 200 words (texts under 50 words as 50)."""
        words = words_of(text)
        hits = [self.evidence(w) for w in {w for w in words if self.evidence(w)}]
        most = max(hits, default=0.0)
        return [most, most * most / 5, float(np.log1p(len(hits))), min(sum(hits), 50.0) / 10, float(np.log1p(200 * len(hits) / max(50, len(words))))]


def _train(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 != 0


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [x or "" for x in column(batch, "text").to_pylist()]


def character_counts(docs: DataFrame) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N**3, np.int64)
        for batch in slices(batches):
            total += trigram_counts([t for i, t in zip(column(batch, "doc_id").to_pylist(), _texts(batch), strict=True) if _train(i)])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["k", "n"])

    out = np.zeros(N**3, np.int64)
    for r in docs.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 27^3 rows
        out[r.k] = r.n
    return out


@dataclass
class Toxicity:
    decoder: Decoder
    weights: np.ndarray
    bias: float

    def score(self, texts: list[str]) -> np.ndarray:
        x = np.array([self.decoder.summary(t) for t in texts]).reshape(-1, SUMMARY)
        return 1 / (1 + np.exp(-(x @ self.weights + self.bias)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, float]:
    x1 = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x1.shape[1]), np.diag([ridge] * x.shape[1] + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x1 @ w))
        step = np.linalg.solve((x1 * (p * (1 - p))[:, None]).T @ x1 + penalty, x1.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Toxicity | None:
    """The model, or None without labels of both kinds."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("y"))
    known = known.where("crc32(cast(doc_id as string)) % 5 <> 0")
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # proven bound: 16 bytes a row of the sample
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("hash"), F.col("y").cast("int").alias("y"), "text")
    decoder = Decoder(log_model(character_counts(docs)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, spelled = {0: Counter(), 1: Counter()}, {}
        for batch in slices(batches, 64):
            for text, y in zip(_texts(batch), column(batch, "y").to_pylist(), strict=True):
                seen = set()
                for w in set(words_of(text)):
                    if w not in spelled:
                        spelled[w] = [f for s in decoder.spellings(w) for f in features(s)]
                    seen.update(spelled[w])
                found[int(y > 0)].update(seen)
                found[int(y > 0)][""] += 1
            if len(spelled) > 200_000:
                spelled.clear()
            if sum(map(len, found.values())) > 400_000:
                yield from flush(found)
        yield from flush(found)

    def flush(found: dict[int, Counter]) -> Iterator[pa.RecordBatch]:
        for y, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([n * y for n in c.values()], pa.int64()), pa.array([n * (1 - y) for n in c.values()], pa.int64())], names=["f", "p", "n"])
            c.clear()

    counted = rows.mapInArrow(count, "f string, p long, n long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).where("p >= 3 or f = ''").toArrow()
    p, n, names = counted["p"].to_numpy().astype(float), counted["n"].to_numpy().astype(float), counted["f"].to_pylist()
    whole = names.index("") if "" in names else -1
    if whole < 0 or not p[whole] or not n[whole]:
        return None
    odds = np.log((p + 0.5) / (p[whole] + 1)) - np.log((n + 0.5) / (n[whole] + 1)) - ERRORS * np.sqrt(1 / (p + 0.5) + 1 / (n + 0.5))
    share = p[whole] / (p[whole] + n[whole])
    ratio = 2 * (p * np.log(p / ((p + n) * share)) + n * np.log(np.maximum(n, 1e-9) / ((p + n) * (1 - share))))
    sure = (odds >= LEAST) & (ratio >= 2 * np.log(len(names)))
    decoder.lexicon = {f: float(e) for f, e, s in zip(names, odds, sure, strict=True) if f and s}
    words = [f for f in decoder.lexicon if not f.endswith("-")]
    decoder.toxic = log_model(20 * trigram_counts(words)) if words else None

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = [decoder.summary(t) for t in _texts(batch)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "hash"), column(batch, "y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "hash", "y", "x"])

    # of rows that share a doc_id the one whose text has the least hash
    made = rows.mapInArrow(summarise, "doc_id long, hash long, y int, x array<double>").groupBy("doc_id").agg(F.max("y").alias("y"), F.min_by("x", "hash").alias("x")).orderBy("doc_id").toArrow()
    x = np.array(made["x"].to_pylist()).reshape(-1, SUMMARY)
    return Toxicity(decoder, *fit_logistic(x, (made["y"].to_numpy() > 0).astype(float)))



def toxicity_scores(docs: DataFrame, model: Toxicity | None) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches):
            s = m.score(_texts(batch)) if m else np.zeros(batch.num_rows)
            held = [not _train(i) for i in column(batch, "doc_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(held), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
