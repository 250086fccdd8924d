"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

The pieces and scores come from a merge-type model file. A text gets the leading mark, spaces become marks, and it falls into
words at marks and line feeds, since no piece has a mark behind another character, or a line feed. In each word an agenda holds the candidate
merges, best score first and leftmost among equals; each merge that is taken from it is skipped with a chance of `rate`, drawn
by a hash keyed by seed, document, the word's position in it and how many were skipped before. With rate 0 this is the
model's own encoding. What a word becomes hangs only on which of the merges taken are skipped, so a worker keeps a tree for
each word: a node holds the ids when no more are skipped and how many merges are taken on that way, a child skips one more
of them. Each occurrence draws how many merges pass before the next skip and goes down until that is beyond the last one;
nodes are made when first met, in any number, and trees are cleared when full, so every occurrence has skips of its own and
common ways are looked up. New nodes of a batch are merged together, their agendas in step.

Characters without a piece become the bytes of their UTF-8 form, and so does the mark itself where a text has it: decoding
gives back every text exactly, whatever was skipped. Null texts are empty and have no ids. Equal doc_id and text give
equal ids, unless a column of copy numbers tells copies apart; a null doc_id is a key like any other. Extra columns are
passed through by encode_documents.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ._common import claim, column, documents, mix64, slices, small_batches, uncollected
from ._pretokens import tokenizer_path

MARK = "▁"
RATE, SEED = 0.1, 11
#: Words of more characters have no tree: each occurrence that skips runs an agenda of its own, once, with its draws inside.
LONG = 48
#: Fewer words than this are merged one by one.
FEW = 64
#: More than the merges that can be taken in a word with a tree: a merge is of a span of it, and taken or skipped once.
DEEP = 4_096
_WORDS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")
_KEPT: dict = {}


def _slot(pair: np.ndarray, odd: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (pair.view(np.uint64) * np.uint64(odd) >> np.uint64(64 - bits)).view(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """Tables by hash, each a multiplier, bits of a slot, keys and values, with some 16 slots for each key: the first holds all keys that come first to their slot, the next what is left.

    The multiplier of a table is the one of a few that leaves the fewest keys."""
    tables, draw = [], np.random.default_rng(1)
    while len(keys):
        tried, bits = [], min(20, len(keys).bit_length() + 4)
        for _ in range(40 if tables else 4):
            odd = int(draw.integers(2**63, 2**64, dtype=np.uint64)) | 1
            tried.append((len(keys) - len(np.unique(_slot(keys, odd, bits))), odd))
        odd = min(tried)[1]
        at = _slot(keys, odd, bits)
        _, first = np.unique(at, return_index=True)
        table, value = np.full(2**bits, -2, np.int64), np.zeros(2**bits, np.int32)
        table[at[first]], value[at[first]] = keys[first], values[first]
        tables.append((odd, bits, table, value))
        left = np.ones(len(keys), bool)
        left[first] = False
        keys, values = keys[left], values[left]
    return tables


class Roots(dict):
    """The node without skips of each word, made when first met."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: str) -> int:
        self[word] = node = self.add(word)
        return node


class Trees:
    """Numbered nodes: a word with certain merges skipped, by their numbers among those taken. For each its ids and how many merges
    are taken; a child, by node * DEEP + number, skips one more. New nodes are listed until they are merged."""

    def __init__(self):
        self.roots, self.children = Roots(self.add), {}  # a cycle: see clear
        self.words: list[str] = []
        self.skips: list[tuple[int, ...]] = []
        self.ids: list[bytes] = []
        self.new: list[int] = []
        self.taken, self.long = np.zeros(1024, np.int64), np.zeros(1024, bool)

    def add(self, word: str, skips: tuple[int, ...] = ()) -> int:
        node = len(self.words)
        self.words.append(word)
        self.skips.append(skips)
        self.ids.append(b"")
        self.new.append(node)
        return node

    def clear(self) -> None:
        """Forgets all nodes in place: dropped as a whole, trees would stay in memory until cycles are collected."""
        for x in (self.roots, self.children, self.words, self.skips, self.ids, self.new):
            x.clear()
        self.taken, self.long = np.zeros(1024, np.int64), np.zeros(1024, bool)

    def room(self) -> None:
        while len(self.taken) < len(self.words):
            self.taken, self.long = np.append(self.taken, np.zeros_like(self.taken)), np.append(self.long, np.zeros_like(self.long))

    def step(self, keys: list[int]) -> np.ndarray:
        """The children that keys name; new ones are made."""
        found = list(map(self.children.get, keys))
        if None in found:
            for k, (key, node) in enumerate(zip(keys, found, strict=True)):
                if node is None:
                    node = self.children.get(key)
                    if node is None:
                        parent, t = divmod(key, DEEP)
                        node = self.children[key] = self.add(self.words[parent], (*self.skips[parent], t))
                    found[k] = node
        return np.array(found, np.int64)


class Codec:
    def __init__(self, path: str, rate: float = RATE, seed: int = SEED, limit: int = 200_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        if n > 65536:
            raise ValueError(f"the model has {n} pieces; ids are kept in 16 bits")
        self.rank: dict[str, tuple[float, int]] = {}
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                self.rank[piece] = (-model.get_score(i), i)
                self.bytes.append(piece.replace(MARK, " ").encode())
                if MARK in piece.lstrip(MARK) or "\n" in piece:
                    raise ValueError(f"piece {piece!r} has a mark behind another character or a line feed")
        self.model, self.known = model, frozenset(p for p in self.rank if len(p) == 1)
        self.rate, self.seed, self.limit = rate, seed, limit
        self.trees = Trees()
        self.escaped = self._bytes(MARK)
        # for merging many words at once: ids of characters, places of pieces in the order of merging, and all pairs that merge
        self.letters = np.full(0x10000, -1, np.int64)
        for piece, (_, i) in self.rank.items():
            if len(piece) == 1 and ord(piece) < 0x10000:
                self.letters[ord(piece)] = i
        self.order = np.zeros(n, np.int32)
        self.order[[i for _, (_, i) in sorted(self.rank.items(), key=lambda x: x[1])]] = np.arange(len(self.rank))
        pairs = {self.rank[p[:k]][1] * n + self.rank[p[k:]][1]: r[1] for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank}
        self.size = n
        self.pairs = _hashed(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))

    def _found(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that pairs merge into, and whether they do."""
        p, fits = np.zeros(len(pair), np.int64), np.zeros(len(pair), bool)
        for odd, bits, keys, merged in self.pairs:
            at = _slot(pair, odd, bits)
            hit = keys[at] == pair
            p += merged[at] * hit
            fits |= hit
        return p, fits

    def _bytes(self, text: str) -> bytes:
        return array("H", [self.byte_ids[b] for b in text.encode()]).tobytes()

    def _merge(self, word: str, skips: tuple[int, ...] = (), place: np.ndarray | None = None) -> tuple[bytes, int]:
        """Ids of a word by an agenda of its own, and how many merges are taken; with an occurrence's place its skips are drawn on the way."""
        taken, depth, left_out = 0, 0, iter(skips)
        skip = next(left_out, -1) if place is None else int(self._gaps(place, 0)[0])
        rank = self.rank.get
        parts: list[str | None] = list(word)
        n = len(parts)
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(*r, i, 2) for i, r in enumerate(map(rank, map(str.__add__, parts, parts[1:]))) if r]
        heapq.heapify(agenda)
        while agenda:
            _, _, i, size = heapq.heappop(agenda)
            a = parts[i]
            j = right[i]
            if a is None or j >= n or len(a) + len(parts[j]) != size:
                continue  # one of the two has merged with another
            taken += 1
            if taken - 1 == skip:
                depth += 1
                skip = next(left_out, -1) if place is None else skip + 1 + int(self._gaps(place, depth)[0])
                continue
            parts[i] = a = a + parts[j]
            parts[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                r = rank(a + parts[k])
                if r:
                    heapq.heappush(agenda, (*r, i, len(a) + len(parts[k])))
            k = left[i]
            if k >= 0:
                r = rank(parts[k] + a)
                if r:
                    heapq.heappush(agenda, (*r, k, len(parts[k]) + len(a)))
        out = bytearray()
        for p in parts:
            if p is not None:
                r = rank(p)
                out += r[1].to_bytes(2, "little") if r else self._bytes(p)
        return bytes(out), taken

    def _alone(self, node: int) -> None:
        t = self.trees
        t.ids[node], t.taken[node] = self._merge(t.words[node], t.skips[node])

    def _merge_many(self, found: list[int]) -> None:
        """Fills nodes: agendas of words of like length advance in step.

        A row is a word's agenda: for each place the best merge that starts there, or none. Each step takes every row's best,
        the leftmost among equals, and renews the two places beside it; where the row skips that step, the merge is only struck out.
        """
        words = self.trees.words
        lengths = np.fromiter((len(words[x]) for x in found), np.int64, len(found))
        order, at = np.argsort(lengths, kind="stable"), 0
        lengths = lengths[order]
        while at < len(order):
            width = int(lengths[at])
            if width > LONG:
                for k in order[at:]:
                    self.trees.long[found[k]] = True
                    self._alone(found[k])
                return
            end = min(at + 4096, int(np.searchsorted(lengths, width + max(2, width // 4), "right")))
            if end - at < FEW:
                for k in order[at:end]:
                    self._alone(found[k])
                at = end
                continue
            self._merge_rows([found[k] for k in order[at:end].tolist()], lengths[at:end])
            at = end

    def _merge_rows(self, found: list[int], lengths: np.ndarray) -> None:
        trees = self.trees
        width = int(lengths[-1])
        flat = np.frombuffer("".join([trees.words[x] for x in found]).encode("utf-32-le"), np.uint32)
        inside = np.arange(width) < lengths[:, None]
        codes = np.zeros(inside.shape, np.uint32)
        codes[inside] = flat
        ids = np.where(inside, self.letters[np.where(codes < 0x10000, codes, 0xFFFF)], -1)
        plain = (ids >= 0).sum(1) == lengths
        if not plain.all():
            for k in np.flatnonzero(~plain):
                self._alone(found[k])
            found = [found[k] for k in np.flatnonzero(plain)]
            if not found:
                return
        ids, lengths, n = ids[plain], lengths[plain], len(found)
        skips = [trees.skips[x] for x in found]
        skipped = np.zeros((n, max((x[-1] + 2 for x in skips if x), default=1)), bool)
        for r, x in enumerate(skips):
            if x:
                skipped[r, list(x)] = True
        taken, step = np.zeros(n, np.int64), 0
        none = np.iinfo(np.int32).max
        # column `width` stands for no place: behind the last and before the first one
        ids = np.column_stack([ids, np.full(n, -1)])
        right = np.tile(np.append(np.arange(1, width + 1), width), (n, 1))
        right[np.arange(n), lengths - 1] = width
        left = np.tile(np.append(np.arange(-1, width - 1), width), (n, 1))
        left[:, 0] = width
        best, piece = np.full((n, width + 1), none, np.int32), np.zeros((n, width + 1), np.int64)

        def renew(rows: np.ndarray, i: np.ndarray) -> None:
            a, b = ids[rows, i], ids[rows, right[rows, i]]
            pair = np.where((a < 0) | (b < 0), -1, a * self.size + b)
            p, fits = self._found(pair)
            best[rows, i] = np.where(fits, self.order[p], none)
            piece[rows, i] = p

        every = np.repeat(np.arange(n), width)
        renew(every, np.tile(np.arange(width), n))
        rows = np.arange(n)
        while True:
            i = best[rows].argmin(1)
            live = best[rows, i] != none
            rows, i = rows[live], i[live]
            if not len(rows):
                break
            taken[rows] += 1
            if step < skipped.shape[1]:
                out = skipped[rows, step]
                best[rows[out], i[out]] = none
                at, i = rows[~out], i[~out]
            else:
                at = rows
            step += 1
            j = right[at, i]
            k = right[at, j]
            ids[at, i], ids[at, j], best[at, j] = piece[at, i], -1, none
            right[at, i] = k
            left[at, k] = i
            left[at, width] = width
            renew(at, i)
            renew(at, left[at, i])
            best[at, width] = none
        alive = ids >= 0
        raw = ids[alive].astype("<u2").tobytes()
        ends = (np.cumsum(alive.sum(1)) * 2).tolist()
        start = 0
        for x, stop in zip(found, ends, strict=True):
            trees.ids[x] = raw[start:stop]
            start = stop
        trees.taken[found] = taken

    def encode_many(self, texts: list[str], keys: list) -> list[np.ndarray]:
        """Ids of each text; keys: of their documents."""
        with uncollected():
            return self._encode(texts, keys)

    def _fill(self) -> None:
        trees = self.trees
        new, trees.new = trees.new, []
        if not new:
            return
        trees.room()
        rest, plain = [], []
        for x in new:
            word = trees.words[x]
            (plain if not trees.skips[x] and len(word) <= LONG and word[0] == MARK != word[-1] and word.count(MARK) == 1 and self.known.issuperset(word) else rest).append(x)
        # without skips and bytes the agenda's result is the library's own, and each merge taken leaves one part less
        words = [trees.words[x] for x in plain]
        for x, word, ids in zip(plain, words, self.model.encode([w[1:] for w in words], num_threads=1) if words else (), strict=True):
            trees.ids[x] = array("H", ids).tobytes()
            trees.taken[x] = len(word) - len(ids)
        self._merge_many(rest)

    def _gaps(self, places: np.ndarray, depth: int) -> np.ndarray:
        """How many merges of each occurrence pass before the next skip, after `depth` skips: geometric at the rate."""
        u = ((mix64(places, depth + 1) >> np.uint64(11)).astype(np.float64) + 1) / 2.0**53
        return (np.log(u) / np.log1p(-self.rate)).clip(0, 2**31).astype(np.int64) if self.rate < 1 else np.zeros(len(places), np.int64)

    def _encode(self, texts: list[str], keys: list) -> list[np.ndarray]:
        if len(self.trees.words) > self.limit:
            self.trees.clear()
        trees, occurrences, places, cut = self.trees, [], [], []
        root = trees.roots.__getitem__
        for text, key in zip(texts, keys, strict=True):
            if not text:
                cut.append(None)
                continue
            parts = text.split(MARK)
            parts[0] = " " + parts[0]
            words = [_WORDS.findall(p.replace(" ", MARK)) for p in parts]
            lengths = list(map(len, words))
            for w in words:
                occurrences.extend(map(root, w))
            cut.append(lengths)
            start = np.uint64(zlib.crc32(str(key).encode(), self.seed) << 32)
            places.append(np.arange(sum(lengths), dtype=np.uint64) + start)
        self._fill()
        nodes, apart = np.array(occurrences, np.int64), {}
        if self.rate and len(nodes):
            place, depth, at = mix64(np.concatenate(places)), 0, np.arange(len(nodes))
            skip = self._gaps(place, 0)
            while True:
                some = skip < trees.taken[nodes[at]]
                at, skip = at[some], skip[some]
                long = trees.long[nodes[at]]
                for i in at[long].tolist():
                    apart[i] = self._merge(trees.words[nodes[i]], place=place[i : i + 1])[0]
                at, skip = at[~long], skip[~long]
                if not len(at):
                    break
                nodes[at] = trees.step((nodes[at] * DEEP + skip).tolist())
                self._fill()
                depth += 1
                skip += 1 + self._gaps(place[at], depth)
        ids, start, out = list(map(trees.ids.__getitem__, nodes.tolist())), 0, []
        for i, x in apart.items():
            ids[i] = x
        for lengths in cut:
            held = []
            for n in lengths or ():
                held.append(b"".join(ids[start : start + n]))
                start += n
            out.append(np.frombuffer(self.escaped.join(held), np.uint16) if lengths is not None else np.empty(0, np.uint16))
        return out

    def encode(self, text: str, key: int | None = None) -> np.ndarray:
        return self.encode_many([text], [key])[0]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


def codec(*options) -> Codec:
    """One codec for each worker and set of options (path, rate, seed, limit)."""
    claim("codec", _KEPT.clear)
    if options not in _KEPT:
        _KEPT[options] = Codec(*options)
    return _KEPT[options]


def encode_documents(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """The documents with one more column, ids; copy: a column that numbers copies from 0, which then have skips of their own."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, rate, seed, 100_000)  # beside the JVM's buffers for whole rows there and back a worker's trees stay small
        for batch in slices(batches, 128):
            keys = column(batch, "doc_id").to_pylist()
            if copy is not None:
                keys = [f"{k}/{n}" if n else k for k, n in zip(keys, column(batch, copy).to_pylist(), strict=True)]
            ids = [x.astype(np.int32) for x in c.encode_many([t or "" for t in column(batch, "text").to_pylist()], keys)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*batch.schema.names, "ids"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(encode, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """The rows with one more column, decoded: the text that their ids stand for."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, RATE, SEED)
        for batch in slices(batches):
            texts = [c.decode(np.array(x or [], np.uint16)) for x in column(batch, "ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return encoded.mapInArrow(decode, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))


def codec_digest(docs: DataFrame, path: str, rate: float = RATE, seed: int = SEED) -> DataFrame:
    """Encodes and decodes in one pass: doc_id, n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids), lossless."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, rate, seed, 1_000_000)  # texts alone pass through here, so the table may be larger
        for batch in slices(batches):
            texts = [t or "" for t in column(batch, "text").to_pylist()]
            ids = c.encode_many(texts, column(batch, "doc_id").to_pylist())
            crc = pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64())
            same = pa.array([c.decode(x) == t for x, t in zip(ids, texts, strict=True)])
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(map(len, ids), pa.int64()), crc, same], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(digest, T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t in (("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("lossless", T.BooleanType())))]))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec_digest(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))
