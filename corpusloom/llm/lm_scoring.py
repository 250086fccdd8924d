"""Language-model scores from a log-bilinear model trained with noise-contrastive estimation.

Token counts cover all training documents. The most frequent tokens, in a number that grows with the corpus, have vectors of their
own, as context and as target; the others share one of each by the end of their spelling. A token's probability has two
factors, so that normalising stays cheap: the most frequent ones are classes of one token, every other token belongs to a
class by the end of its spelling, and P(token | context) = P(class | context) * P(token | class, context). The vectors of
the two tokens before and the mean of the last few, each times a matrix, add up to a predicted vector; its products with
the vectors of all classes, and then of all members of the class, plus biases, are normalised into log-probabilities. The tokens of a
class without a vector and its unknown ones are one member together, in which each has its smoothed share of counts,
so that the probabilities of all known tokens and the unknown slots add up to one.

Training is data-parallel over all training documents and does not hang on partitioning: documents are dealt into shards by a
hash of their id and text and stand in the order of another one. In each round every shard runs noise-contrastive steps
in numpy from the same start, with the AdaGrad sums of the round before, and the parameters are averaged row by row, by how
often a shard has changed them, in a tree over the shards. Scores agree for any partitioning up to the rounding of
32-bit sums.

Counts of the most frequent tokens go to the workers; those of the others stay a table and are joined, so nothing that grows
like the whole vocabulary is broadcast: what is sent grows as the 0.4th power of the corpus (`own_tokens`). Null
texts are empty and score their end token alone. Rows that share a doc_id are scored each by itself; a null doc_id
trains. Without training documents score and base_score agree.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import column, documents, scoped, slices, staged, text_bytes

#: At least so many tokens' counts are sent to the workers; classes of one token.
HEAD, SINGLE = 150_000, 128
#: Vector size, tokens before that are averaged (a power of two), batch size, noise classes per batch, noise members per token, weight of the noise, rate.
SIZE, WINDOW, BATCH, NOISE, MEMBERS, RATIO, RATE = 20, 8, 4_096, 32, 2, 8, 0.1
#: A shard has so many training tokens for each token with a vector; small corpora are gone through up to PASSES times, while under ENOUGH tokens.
SHARD, PASSES, ENOUGH = 64, 4, 1_200_000
#: Rows of parameters sent together; shards averaged together.
BLOCK, FAN = 1_024, 64
END = b"\n"


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 1


def own_tokens(total: int) -> int:
    """How many tokens have vectors of their own, at most, in a corpus of so many."""
    return int(10_000 + 15 * total**0.4)


def token_counts(docs: DataFrame) -> DataFrame:
    """token, c over all training documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), text_bytes(batch), strict=True):
                if not is_held_out(doc_id):
                    found.update(text.lower().split())
                    found[END] += 1
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "c"])
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["token", "c"])

    return docs.mapInArrow(count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """What the workers need of the counts: the head's tokens, most frequent first, how many of them have vectors, and the weight
    of the tokens of each spelled class that have none."""

    tokens: list[bytes]
    counts: np.ndarray
    own: int
    total: int
    distinct: int
    rest: np.ndarray
    ids: dict = field(default_factory=dict, repr=False)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def weight(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)


def spelled(token: bytes, groups: int) -> int:
    return crc32(token[-3:]) % groups


def fit_vocabulary(counts: DataFrame, head: int | None = None) -> Vocabulary:
    """head: how many tokens' counts are sent, instead of HEAD or all that have vectors."""
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") > 1, 1)).alias("often")).first()
    own = min(whole.often, own_tokens(whole.n))
    head = max(own, HEAD) if head is None else head
    # sixteen bins for each power of two tell from which count on there are enough tokens, so that little more than them is sorted
    bins = counts.groupBy(F.floor(F.log2(F.col("c")) * 16).alias("bin")).count().orderBy(F.desc("bin")).collect()
    least, n = 0, 0
    for b in bins:
        least, n = b.bin, n + b["count"]
        if n >= head:
            break
    top = counts.where(F.floor(F.log2(F.col("c")) * 16) >= least).orderBy(F.desc("c"), "token").limit(head).toArrow()
    tokens = [bytes(x) for x in top["token"].to_pylist()]
    own = min(own, len(tokens))
    groups = max(1, round(math.sqrt(own)))
    given = counts.sparkSession.sparkContext.broadcast(frozenset(tokens[:own]))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(groups), given.value
        for batch in batches:
            for t, c in zip(column(batch, "token").to_pylist(), column(batch, "c").to_pylist(), strict=True):
                if t not in known:
                    sums[spelled(t, groups)] += c + 0.5
        yield pa.RecordBatch.from_arrays([pa.array(range(groups), pa.int32()), pa.array(sums)], names=["k", "w"])

    rest = np.full(groups, 0.5)
    for r in counts.mapInArrow(weigh, "k int, w double").groupBy("k").agg(F.sum("w").alias("w")).collect():
        rest[r.k] += r.w
    given.unpersist()
    return Vocabulary(tokens, top["c"].to_numpy().astype(np.int64), own, whole.n, whole.v, rest)


class Layout:
    """Codes, classes and members. A code is the place of a token with a vector, or own + its spelled class, or `begin`."""

    def __init__(self, v: Vocabulary):
        self.own, self.groups, self.single = v.own, len(v.rest), min(SINGLE, v.own)
        self.begin, self.classes = v.own + self.groups, self.single + self.groups
        weights = v.counts[: v.own] + 0.5
        group = np.fromiter((spelled(t, self.groups) for t in v.tokens[self.single : v.own]), np.int64, v.own - self.single)
        # members stand by class; the first of a class is what has no vector
        of = np.concatenate([np.arange(self.groups), group])
        order = np.argsort(of, kind="stable")
        row = np.empty(len(of), np.int64)
        row[order] = np.arange(len(of))
        self.members, self.first = len(of), np.concatenate([[0], np.cumsum(np.bincount(of, minlength=self.groups))])
        self.member_of = np.concatenate([np.full(self.single, -1), row[self.groups :], row[: self.groups]])
        self.class_of = np.concatenate([np.arange(self.single), self.single + group, self.single + np.arange(self.groups)])
        w = np.concatenate([v.rest, weights[self.single :]])[order]
        sums = np.add.reduceat(w, self.first[:-1])
        self.class_share = np.concatenate([weights[: self.single], sums])
        self.class_share /= self.class_share.sum()
        self.member_share = w / np.repeat(sums, np.diff(self.first))

    def places(self) -> np.ndarray:
        """For each member its class and the share of the members up to it, added: where class + uniform falls draws a member."""
        out = np.empty(self.members)
        for g in range(self.groups):
            a, b = self.first[g], self.first[g + 1]
            out[a:b] = g + np.minimum(np.cumsum(self.member_share[a:b]), 1)
            out[b - 1] = g + 1
        return out


_READY: dict = {}


def _ready(shared) -> Vocabulary:
    """The broadcast vocabulary with its index, built once per worker."""
    v = shared.value
    if v.name not in _READY:
        _READY.clear()
        v.ids = {t: i for i, t in enumerate(v.tokens)}
        _READY[v.name] = v
    return _READY[v.name]


ENCODED = "row long, doc_id long, deal long, held_out boolean, n_tokens long, head_known long, head_log double, own_log double, rest_log double, codes binary, tail array<struct<token: binary, tf: long>>"


def encoded(docs: DataFrame, vocabulary) -> DataFrame:
    """Each document's codes, what its head tokens add to the scores, and its other tokens, from a broadcast vocabulary."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, row = _ready(vocabulary), TaskContext.get().partitionId() << 33
        get, own, groups = v.ids.get, v.own, len(v.rest)
        # by place in the head, and one more for tokens beyond it
        codes = np.array([*(i if i < own else own + spelled(t, groups) for i, t in enumerate(v.tokens)), 0], np.uint32)
        logs = np.append(np.log10(v.counts + 0.5), 0.0)
        own_logs, rest = np.where(np.arange(len(logs)) < own, logs, 0.0), np.concatenate([np.zeros(own), np.log10(v.rest)])
        for batch in slices(batches, 64):
            texts = [x.lower().split() for x in text_bytes(batch)]
            for words in texts:
                words.append(END)
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            ends = np.cumsum(lengths)
            starts, flat = ends - lengths, list(chain.from_iterable(texts))
            ids = np.fromiter(map(get, flat, repeat(-1)), np.int64, len(flat))
            of, beyond = codes[ids], np.flatnonzero(ids < 0)
            tokens = [flat[i] for i in beyond.tolist()]
            of[beyond] = [own + crc32(t[-3:]) % groups for t in tokens]
            cut = np.searchsorted(beyond, np.append(starts, len(flat))).tolist()
            tails = [Counter(tokens[a:b]) for a, b in zip(cut, cut[1:])]  # noqa: B905
            sums = [np.add.reduceat(x, starts) if len(starts) else np.empty(0) for x in (logs[ids], own_logs[ids], rest[of])]
            raw, edges = of.tobytes(), (ends * of.itemsize).tolist()
            each = [raw[a:b] for a, b in zip([0, *edges], edges)]  # noqa: B905
            held, doc_ids = [is_held_out(x) for x in column(batch, "doc_id").to_pylist()], column(batch, "doc_id")
            inner = pa.StructArray.from_arrays([pa.array(chain.from_iterable(tails), pa.binary()), pa.array(chain.from_iterable(c.values() for c in tails), pa.int64())], names=["token", "tf"])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.fromiter(map(len, tails), np.int64, len(tails)))]), pa.int32())
            arrays = [
                pa.array(np.arange(row, row + len(texts)), pa.int64()), doc_ids, column(batch, "deal"), pa.array(held, pa.bool_()), pa.array(lengths), pa.array(lengths - np.diff(cut)),
                *(pa.array(x, pa.float64()) for x in sums), pa.array(each, pa.binary()), pa.ListArray.from_arrays(offsets, inner),
            ]
            row += len(texts)
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in ENCODED.split(", ")[:10]] + ["tail"])

    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("deal"), "text").mapInArrow(encode, ENCODED)


def stream_of(sequences: list[np.ndarray], begin: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes of documents one after another, WINDOW times `begin` before each, and where each one's own start."""
    lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
    starts = np.cumsum(lengths + WINDOW) - lengths
    out = np.full(int((lengths + WINDOW).sum()), begin, np.int64)
    for at, codes in zip(starts.tolist(), sequences, strict=True):
        out[at : at + len(codes)] = codes
    return out, starts


def _window_sums(x: np.ndarray, back: bool = False) -> np.ndarray:
    """For each row the sum of it and the WINDOW - 1 rows before (or behind), by doubling."""
    x, k = x.copy(), 1
    while k < WINDOW:
        y = x.copy()
        if back:
            y[:-k] += x[k:]
        else:
            y[k:] += x[:-k]
        x, k = y, 2 * k
    return x


def _order(at: np.ndarray) -> np.ndarray:
    """A stable order of numbers from 0 on, by 16 bits at a time, which numpy sorts by their digits."""
    order, at = np.argsort(at.astype(np.uint16), kind="stable"), at >> 16
    while at.any():
        order, at = order.take(np.argsort(at.take(order).astype(np.uint16), kind="stable")), at >> 16
    return order


def _scatter(at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different places among `at`, and the sums of the rows of each."""
    order = _order(at)
    placed = at.take(order)
    new = np.append(True, placed[1:] != placed[:-1])
    first = np.flatnonzero(new)
    if 2 * len(first) < len(at):
        return placed.take(first), np.add.reduceat(rows.take(order, axis=0), first)
    # most places have one row, which is its own sum
    out, alone = rows.take(order.take(first), axis=0), new & np.append(new[1:], True)
    many = np.flatnonzero(~alone.take(first))
    if len(many):
        left = np.flatnonzero(~alone)
        out[many] = np.add.reduceat(rows.take(order.take(left), axis=0), np.flatnonzero(new.take(left)))
    return placed.take(first), out


@dataclass
class LogBilinear:
    """context: vectors of codes as context; target: of classes, and member: of members, each with a bias behind; mix: matrices
    for the code one and two places back and the window's mean. sums: of each row's squared gradients, on average."""

    context: np.ndarray
    target: np.ndarray
    member: np.ndarray
    mix: np.ndarray
    sums: list[np.ndarray]
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def start(cls, layout: Layout, size: int = SIZE, seed: int = 5) -> LogBilinear:
        draw = np.random.default_rng(seed)
        small = lambda n: draw.normal(0, 0.1, (n, size)).astype(np.float32)
        bias = lambda share: np.log(share).astype(np.float32)
        eye = np.eye(size, dtype=np.float32)
        parts = [small(layout.begin + 1), np.column_stack([small(layout.classes), bias(layout.class_share)]), np.column_stack([np.zeros((layout.members, size), np.float32), bias(layout.member_share)]), np.concatenate([eye, 0.5 * eye, eye])]
        return cls(*parts, [np.full(len(p), 0.1, np.float32) for p in parts])

    def parts(self) -> list[np.ndarray]:
        return [self.context, self.target, self.member, self.mix]

    def matrices(self) -> np.ndarray:
        return self.mix.reshape(3, -1, self.mix.shape[1])

    def predicted(self, stream: np.ndarray, begin: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """Places of tokens in a stream, less the first `lead`, their predicted vectors, the three parts that these are made
        of, and how many tokens each one's window holds."""
        x, real = self.context.take(stream, axis=0), stream != begin
        at = np.flatnonzero(real[lead:]) + lead
        many = np.maximum(1, _window_sums(real.astype(np.float32)))[at - 1, None]
        made = [x.take(at - 1, axis=0), x.take(at - 2, axis=0), _window_sums(x * real[:, None]).take(at - 1, axis=0) / many]
        return at, sum(y @ m for y, m in zip(made, self.matrices(), strict=True)), made, many

    def log_probabilities(self, stream: np.ndarray, layout: Layout, lead: int = 0) -> np.ndarray:
        """Natural logarithms for each token of a stream, less the first `lead` places; those of a shared member are of the member as a whole."""
        at, q, _, _ = self.predicted(stream, layout.begin, lead)
        q = np.column_stack([q, np.ones(len(q), np.float32)])  # for the biases
        classes, members = layout.class_of[stream[at]], layout.member_of[stream[at]]
        out, across = np.empty(len(q)), np.ascontiguousarray(self.target.T)
        for a in range(0, len(q), 512):
            out[a : a + 512] = _normalised(q[a : a + 512] @ across, classes[a : a + 512])
        within = np.flatnonzero(members >= 0)
        within = within[_order(classes[within])]
        group = classes[within] - layout.single
        cut = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            first, last = layout.first[group[a]], layout.first[group[a] + 1]
            for part in range(a, b, 512):
                these = within[part : min(b, part + 512)]
                out[these] += _normalised(q.take(these, axis=0) @ self.member[first:last].T, members[these] - first)
        return out


def _normalised(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of the softmax of each row of s at one column. Rows whose sums leave the range of 32 bits are shifted by their
    greatest first."""
    own = s.take(np.arange(0, s.size, s.shape[1]) + at)
    with np.errstate(over="ignore"):
        sums = np.exp(s) @ np.ones(s.shape[1], np.float32)
    if 1e-25 <= sums.min() and sums.max() < 1e25:
        return own - np.log(sums)
    out = own - np.log(np.clip(sums, 1e-30, 1e30))
    far = (sums < 1e-25) | ~(sums < 1e25)
    top = s[far].max(1)
    out[far] = own[far] - top - np.log(np.exp(s[far] - top[:, None]).sum(1))
    return out


class Trainer:
    """Noise-contrastive steps on a model of its own; counts how often each row of a part has changed."""

    def __init__(self, model: LogBilinear, layout: Layout, seed: int):
        self.model = LogBilinear(*(p.copy() for p in model.parts()), [])
        self.layout, self.draw = layout, np.random.default_rng(seed)
        self.state = [np.repeat(s[:, None], p.shape[1], 1) for s, p in zip(model.sums, model.parts(), strict=True)]
        self.touched = [np.zeros(len(p), np.int64) for p in model.parts()]
        self.class_level = np.log(layout.class_share * RATIO).astype(np.float32)
        self.member_level = np.log(layout.member_share * RATIO).astype(np.float32)
        self.class_places, self.member_places = np.cumsum(layout.class_share), layout.places()

    def _change(self, part: int, at: np.ndarray, g: np.ndarray, rate: float = RATE) -> None:
        s, p = self.state[part].take(at, axis=0), self.model.parts()[part]
        s += g * g
        self.state[part][at] = s
        s += np.float32(1e-8)
        change = np.float32(rate) * g
        change /= np.sqrt(s, out=s)
        p[at] = np.subtract(p.take(at, axis=0), change, out=change)
        self.touched[part][at] += 1

    def step(self, stream: np.ndarray, lead: int) -> None:
        """One step on the tokens of a stream, less the first `lead` places, which are context only."""
        m, lay = self.model, self.layout
        size = m.mix.shape[1]
        places, q, made, many = m.predicted(stream, lay.begin, lead)
        if not len(places):
            return
        q = np.column_stack([q, np.ones(len(q), np.float32)])
        classes, members = lay.class_of[stream[places]], lay.member_of[stream[places]]
        # classes against noise classes that the batch shares
        noise = np.searchsorted(self.class_places, self.draw.random(NOISE)).clip(0, lay.classes - 1)
        own, other = m.target.take(classes, axis=0), m.target[noise]
        good = -1 / (1 + np.exp(np.einsum("ij,ij->i", q, own) - self.class_level[classes]))
        bad = RATIO / NOISE / (1 + np.exp(self.class_level[noise] - q @ other.T))
        dq = good[:, None] * own + bad @ other
        target = _scatter(np.concatenate([classes, noise]), np.concatenate([good[:, None] * q, bad.T @ q]))
        # members against noise members of the same class
        at = np.flatnonzero(members >= 0)
        if len(at):
            right, x = members[at], q.take(at, axis=0)
            noise = np.searchsorted(self.member_places, (classes[at] - lay.single)[:, None] + self.draw.random((len(at), MEMBERS))).clip(0, lay.members - 1)
            own, found = m.member.take(right, axis=0), [right]
            good = -1 / (1 + np.exp(np.einsum("ij,ij->i", x, own) - self.member_level[right]))
            dx, rows = good[:, None] * own, [good[:, None] * x]
            for k in range(MEMBERS):
                wrong = noise[:, k]
                other = m.member.take(wrong, axis=0)
                bad = RATIO / MEMBERS / (1 + np.exp(self.member_level[wrong] - np.einsum("ij,ij->i", x, other)))
                dx += bad[:, None] * other
                found.append(wrong)
                rows.append(bad[:, None] * x)
            dq[at] += dx
            member = _scatter(np.concatenate(found), np.concatenate(rows))
        dq = np.ascontiguousarray(dq[:, :size])
        first, second, mean = m.matrices()
        mix = np.concatenate([x.T @ dq for x in made])
        # each code's vector stands one and two places back of the next ones, and in their windows
        dx = np.zeros((len(stream), size), np.float32)
        dx[places - 1] = dq @ mean.T / many
        dx = _window_sums(dx, back=True)
        dx[stream == lay.begin] = 0
        dx[places - 1] += dq @ first.T
        dx[places - 2] += dq @ second.T
        self._change(0, *_scatter(stream, dx))
        self._change(1, *target)
        if len(at):
            self._change(2, *member)
        self._change(3, np.arange(len(mix)), mix, RATE / 10)

    def train(self, documents: Iterator[np.ndarray]) -> int:
        """Batches of one size over all documents one after another, and the rest; returns the tokens."""
        held, n, total = [], 0, 0
        before = np.full(WINDOW, self.layout.begin)

        def run() -> None:
            nonlocal held, n, before
            stream = np.concatenate([before, stream_of(held, self.layout.begin)[0]])
            for at in range(WINDOW, len(stream), BATCH):
                self.step(stream[at - WINDOW : at + BATCH], WINDOW)
            held, n, before = [], 0, stream[-WINDOW:]

        for codes in documents:
            held.append(codes)
            n += len(codes)
            total += len(codes)
            if n >= 16 * BATCH:
                run()
        if n:
            run()
        return total


PIECES = "block int, part int, places binary, weights binary, rows binary"


def _pieces(trainer: Trainer, shard: int) -> Iterator[pa.RecordBatch]:
    """The changed rows: parameters, bias (or 0) and mean of the AdaGrad sums, by blocks of all parts' rows one after another."""
    size, start = trainer.model.mix.shape[1], 0
    for p, s, n in zip(trainer.model.parts(), trainer.state, trainer.touched, strict=True):
        at = np.flatnonzero(n)
        rows = np.zeros((len(at), size + 2), np.float32)
        rows[:, : p.shape[1]], rows[:, -1] = p[at], s[at].mean(1)
        at = at + start
        start += len(p)
        cut = np.flatnonzero(np.concatenate([[True], at[1:] // BLOCK != at[:-1] // BLOCK, [True]])) if len(at) else [0]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            values = [int(at[a]) // BLOCK], [shard], [at[a:b].tobytes()], [n[at[a:b] - start + len(p)].astype(np.float64).tobytes()], [rows[a:b].tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "places", "weights", "rows"])


def _averaged(table: pa.Table) -> pa.Table:
    """One block's rows of up to FAN shards as one, averaged by weight; the order of the shards settles the rounding."""
    found = sorted(zip(*(table[c].to_pylist() for c in ("part", "places", "weights", "rows")), strict=True), key=lambda x: (x[0], x[1]))
    at, w = (np.concatenate([np.frombuffer(x[k], t) for x in found]) for k, t in ((1, np.int64), (2, np.float64)))
    rows = np.concatenate([np.frombuffer(x[3], np.float32).reshape(len(x[1]) // 8, -1) for x in found])
    places, sums = _scatter(at, np.column_stack([w, w[:, None] * rows]))
    values = [table["block"][0].as_py()], [found[0][0] // FAN], [places.tobytes()], [sums[:, 0].tobytes()], [(sums[:, 1:] / sums[:, :1]).astype(np.float32).tobytes()]
    return pa.table(dict(zip(("block", "part", "places", "weights", "rows"), (pa.array(x, t) for x, t in zip(values, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)), strict=True)))


def fit_model(rows: DataFrame, vocabulary, rounds: int | None = None) -> LogBilinear:
    """Trains on the codes of all training documents: once through in two rounds of averaging, small corpora more often."""
    context, v = rows.sparkSession.sparkContext, vocabulary.value
    layout = Layout(v)
    model, shards = LogBilinear.start(layout), max(1, round(v.total / (SHARD * max(1, v.own))))
    passes = min(PASSES, max(1, math.ceil(ENOUGH / max(1, v.total))))
    rounds, of = rounds or max(2, passes), 1 if passes > 1 or rounds == 1 else 2
    shard, order = F.pmod("deal", F.lit(shards)).cast("int"), F.xxhash64(F.lit(1), "deal")
    for k in range(rounds):
        given = context.broadcast(model)

        def fit(batches: Iterator[pa.RecordBatch], k=k, given=given) -> Iterator[pa.RecordBatch]:
            trainer, mine = None, 0

            def documents() -> Iterator[np.ndarray]:
                nonlocal mine
                for batch in slices(batches):
                    mine = column(batch, "shard")[0].as_py() if batch.num_rows else mine
                    for x in column(batch, "codes").to_pylist():
                        yield np.frombuffer(x, np.uint32)

            trainer = Trainer(given.value, _layout(vocabulary.value), 17 + k)
            if trainer.train(documents()):
                yield from _pieces(trainer, mine)

        mine = rows.where("not held_out").where(F.pmod(F.xxhash64(F.lit(2), "deal"), F.lit(of)) == k % of)
        dealt = mine.select(shard.alias("shard"), order.alias("order"), "codes").repartitionById(shards, F.col("shard")).sortWithinPartitions("order")
        made, parts = dealt.mapInArrow(fit, PIECES), shards
        while True:
            made = made.groupBy("block", F.floor(F.col("part") / FAN).alias("fan")).applyInArrow(_averaged, PIECES)
            parts = -(-parts // FAN)
            if parts == 1:
                break
        found = made.toArrow()  # as many rows as the model has
        given.unpersist()
        parts, sums = [p.copy() for p in model.parts()], [s.copy() for s in model.sums]
        at = np.concatenate([np.frombuffer(x, np.int64) for x in found["places"].to_pylist()] or [np.empty(0, np.int64)])
        new = np.concatenate([np.frombuffer(x, np.float32) for x in found["rows"].to_pylist()] or [np.empty(0, np.float32)]).reshape(len(at), -1)
        start = 0
        for p, s in zip(parts, sums, strict=True):
            inside = (at >= start) & (at < start + len(p))
            p[at[inside] - start], s[at[inside] - start] = new[inside, : p.shape[1]], new[inside, -1]
            start += len(p)
        model = LogBilinear(*parts, sums)
    return model


_LAYOUTS: dict = {}


def _layout(v: Vocabulary) -> Layout:
    if v.name not in _LAYOUTS:
        _LAYOUTS.clear()
        _LAYOUTS[v.name] = Layout(v)
    return _LAYOUTS[v.name]


def code_scores(rows: DataFrame, model, vocabulary) -> DataFrame:
    """row, and the log10 probability of its codes."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, layout, run = model.value, _layout(vocabulary.value), 65_536
        for batch in slices(batches):
            seqs = [np.frombuffer(x, np.uint32) for x in column(batch, "codes").to_pylist()]
            if not seqs:
                continue
            stream, starts = stream_of(seqs, layout.begin)
            each = np.zeros(len(stream))
            for at in range(WINDOW, len(stream), run):
                part = stream[at - WINDOW : at + run]  # the first places only as context
                each[np.flatnonzero(part[WINDOW:] != layout.begin) + at] = m.log_probabilities(part, layout, WINDOW)
            yield pa.RecordBatch.from_arrays([column(batch, "row"), pa.array(np.add.reduceat(each, starts - WINDOW) / np.log(10))], names=["row", "nn"])

    return rows.select("row", "codes").mapInArrow(score, "row long, nn double")


@scoped
def score_documents(docs: DataFrame, head: int | None = None, rounds: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    counts = staged(token_counts(docs), "counts")
    fitted = fit_vocabulary(counts, head)
    vocabulary = spark.sparkContext.broadcast(fitted)
    rows = staged(encoded(docs, vocabulary), "encoded")
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.token", "t.tf").join(counts, "token", "left")
    tail = tail.groupBy("row").agg(F.sum(F.col("tf") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("tail_log"), F.sum(F.when(F.col("c") > 0, F.col("tf"))).alias("tail_known"))
    whole = rows.drop("codes", "tail").join(tail, "row", "left")
    base = F.col("head_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("n_tokens") * float(np.log10(fitted.weight))
    score = base
    if fitted.total:
        model = spark.sparkContext.broadcast(fit_model(rows, vocabulary, rounds))
        whole = whole.join(code_scores(rows, model, vocabulary), "row")
        score = F.col("nn") + F.col("head_log") - F.col("own_log") + F.coalesce("tail_log", F.lit(0.0)) - F.col("rest_log")
    return whole.select("doc_id", "held_out", "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(fitted.total).cast("long").alias("train_tokens"), base.alias("base_score"), score.alias("score"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
