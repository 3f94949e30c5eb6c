"""Token ids and counts from a public tokenizer file, with a bounded cache of pieces between white space."""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain
from string import ascii_uppercase

import numpy as np

from .common import worker_cache

#: A piece longer than this is not kept in the cache.
LONGEST_KEPT = 48


class PieceEncoder:
    """Ids of whole texts for a tokenizer that drops white space and marks the ends of words.

    Such a tokenizer never joins characters across white space, so the ids of a text are those of its
    pieces between blanks, tabs and line ends, one after the other. A cache of pieces spares most of the
    work. It has two generations: when the younger is full it becomes the older, so frequent pieces stay
    and ``most`` bounds the memory. The unknown words of a text are encoded in one call, and told apart
    by the ends of words.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most, self.pieces, self.older, self.using = most, {}, {}, set()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self.ends[i] = token.endswith("</w>")
        self.marks = {c: self._encode(c) for c in ",."}
        # capitals A-Z say nothing to a tokenizer that lowers them, but where they could become an added token
        self.lowers = all(self._encode(c) == self._encode(c.lower()) for c in ascii_uppercase)
        self.added = {str(x)[0] for x in self.tokenizer.get_added_tokens_decoder().values()}

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Ids of words that have only letters, in lower case too."""
        if not words:
            return {}
        ids = self._encode(" ".join(words))
        cuts = (np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1).tolist()
        if len(cuts) != len(words):
            return {x: self._encode(x) for x in words}
        return {x: ids[4 * i : 4 * j] for x, i, j in zip(words, [0, *cuts], cuts, strict=False)}

    def _learn(self, pieces: set[str]) -> None:
        """Put pieces that the younger generation lacks into it."""
        if len(self.pieces) >= self.most // 2:
            self.older, self.pieces = self.pieces, {}
            pieces = pieces | {x for x in self.using if x not in pieces}
        known, older, words, marked, odd = self.pieces, self.older, [], [], []
        for piece in pieces:
            if piece in older:
                known[piece] = older[piece]
            elif piece.isalpha() and piece.lower().isalpha():  # a few letters become more than letters
                words.append(piece)
            elif piece[-1:] in self.marks and piece[:-1].isalpha() and piece[:-1].lower().isalpha():
                marked.append(piece)
            else:
                odd.append(piece)
        words += {x[:-1] for x in marked}.difference(known, words)
        known.update(self._words(words))
        for piece in marked:
            known[piece] = known[piece[:-1]] + self.marks[piece[-1]]
        if odd:
            known.update(zip(odd, (np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)), strict=True))

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """ids() of some texts, whose unknown pieces are encoded together."""
        split = [self._plain(x).replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if x else [] for x in texts]
        self.using = set(chain.from_iterable(split))
        if new := self.using.difference(self.pieces):
            self._learn(new)
        get = self.pieces.__getitem__
        got = [b"".join(map(get, x)) for x in split]
        for piece in new:
            if len(piece) > LONGEST_KEPT:
                del self.pieces[piece]
        return got

    def _plain(self, text: str) -> str:
        return text.encode().lower().decode() if self.lowers and not any(c in text for c in self.added) else text

    def count(self, text: str | None) -> int:
        return len(self.ids(text)) // 4


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; later tasks of the worker find its cache filled."""
    kept = worker_cache("tokens")
    if path not in kept:
        kept[path] = PieceEncoder(path)
    return kept[path]


def together(texts: list[str | None], size: int = 1 << 12) -> Iterator[list[str | None]]:
    """The texts in order, some at a time: until they have ``size`` characters."""
    held: list[str | None] = []
    n = 0
    for text in texts:
        held.append(text)
        n += len(text or "")
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held
