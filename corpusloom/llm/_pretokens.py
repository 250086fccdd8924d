"""Byte-level BPE of whole texts by way of their pre-tokens.

A byte-level tokenizer takes its added tokens out of a text, as <|endoftext|>, cuts what lies between them by a fixed pattern
and merges inside each piece alone, so the ids of a text are the ids of its pieces one after another. Pieces repeat, so
each distinct piece goes through the merges of the tokenizers library once per worker and is then looked up. The table
is cleared when full, so memory stays bounded.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np

from ._common import claim, uncollected

_KEPT: dict = {}
#: The letters, numbers and white space up to U+00FF, and the tokenizer's pattern written with them.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", " \t\n\r\f\v\x85\xa0"
LATIN_PATTERN = f" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class Encoder:
    def __init__(self, path: str, limit: int = 600_000):
        import re

        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: (i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for _, t in added.values()):
            raise ValueError("added tokens that take neighbouring characters with them, or are whole words only, are not supported")
        self.added = {content: i for content, (i, _) in added.items()}
        longest = sorted(map(re.escape, self.added), key=lambda x: (-len(x), x))
        self.apart = re.compile(f"({'|'.join(longest)})") if longest else None
        self.merge = self.tokenizer.model.tokenize
        self.letters = byte_letters()
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.latin = re.compile(LATIN_PATTERN)
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 65536 else np.dtype("<u4")
        self.ids: dict[str, bytes] = {}
        self.limit = limit

    def _learn(self, pieces: set[str]) -> None:
        for p in pieces:
            if p in self.added:
                self.ids[p] = array(self.dtype.char, [self.added[p]]).tobytes()
                continue
            plain = p.replace(" ", self.letters[0x20]) if p.isascii() and p.isprintable() else p.encode().decode("latin-1").translate(self.letters)
            self.ids[p] = array(self.dtype.char, [x.id for x in self.merge(plain)]).tobytes()

    def _cut(self, text: str) -> list[str]:
        """Added tokens, and the pattern's pieces of what lies between them."""
        if self.apart and any(t in text for t in self.added):
            return list(chain.from_iterable([x] if x in self.added else self._cut_plain(x) for x in self.apart.split(text) if x))
        return self._cut_plain(text)

    def _cut_plain(self, text: str) -> list[str]:
        """The pattern's pieces; texts that Latin-1 can hold are cut by an equal pattern that names its letters."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pattern.findall(text)
        return self.latin.findall(text)

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The pieces of each text; afterwards the table holds the ids of all of them."""
        with uncollected():
            return self._pieces(texts)

    def _pieces(self, texts: list[str]) -> list[list[str]]:
        out = list(map(self._cut, texts))
        new = set(chain.from_iterable(out)).difference(self.ids)
        if len(self.ids) + len(new) > self.limit:
            self.ids.clear()
            new = set(chain.from_iterable(out))
        self._learn(new)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian bytes of self.dtype."""
        return [b"".join(map(self.ids.__getitem__, x)) for x in self.pieces(texts)]

    def runs(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """For each text its pieces, their lengths in characters, and how many tokens each has."""
        for x in self.pieces(texts):
            yield x, np.fromiter(map(len, x), np.int64, len(x)), np.fromiter(map(len, map(self.ids.__getitem__, x)), np.int64, len(x)) // self.dtype.itemsize

    def offsets(self, piece: str) -> list[tuple[int, int]]:
        """Character spans of one piece's tokens."""
        return self.tokenizer.encode(piece, add_special_tokens=False).offsets


def byte_letters() -> dict[int, str]:
    """The visible letter that byte-level tokenizers write for each byte: itself if printable, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    claim("encoder", _KEPT.clear)
    if path not in _KEPT:
        _KEPT[path] = Encoder(path)
    return _KEPT[path]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
