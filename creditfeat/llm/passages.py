"""Fixed-length features of the passages of a text, for the classifiers.

A passage is a run of ``passage_words`` words. Its features are the shares of its words by hash bin
(square roots of them) and the surface of its words: length, case, digits, symbols, punctuation,
other letters, repetition. Nothing about them is learned, so every worker computes the same ones.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from creditfeat.llm.common import worker_state

_SYMBOLS = frozenset("#*$%&|<>!^~@")
# Words kept by a worker's cache before it starts anew, and words turned into features at once.
CACHE_WORDS = 400_000
CHUNK_WORDS = 200_000


@dataclass(frozen=True)
class Encoding:
    """``bins``: hash bins of words; ``passage_words``: words of a passage."""

    bins: int = 256
    passage_words: int = 64

    @property
    def width(self) -> int:
        return self.bins + 9


class _Words(dict):
    """Word to its number; fills itself and keeps the traits of new words until ``table`` is read."""

    def __init__(self, bins: int) -> None:
        super().__init__()
        self.bins, self._new = bins, []
        self._table = np.zeros((4096, 7), np.float32)

    def __missing__(self, word: str) -> int:
        n = len(word)
        other = 0 if word.isascii() else sum(c > "\x7f" for c in word)
        key = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % self.bins
        if word.isalpha() and word.islower():
            self._new.append((key, n / 10, 0.0, 0.0, 0.0, 0.0, other / n))
        else:
            upper = sum(map(str.isupper, word))
            digit = sum(map(str.isdigit, word))
            symbol = sum(map(_SYMBOLS.__contains__, word))
            rest = n - sum(map(str.isalpha, word)) - digit - symbol
            self._new.append((key, n / 10, upper / n, digit / n, symbol / n, rest / n, other / n))
        self[word] = at = len(self)
        return at

    def table(self) -> np.ndarray:
        """A row of traits for each word."""
        first = len(self) - len(self._new)
        if self._new:
            if len(self) > len(self._table):
                self._table = np.resize(self._table, (2 * len(self), 7))
            self._table[first : len(self)] = self._new
            self._new = []
        return self._table


class PassageEncoder:
    """Encodes texts in chunks; one object for each worker, as it keeps a cache of words."""

    def __init__(self, encoding: Encoding = Encoding()) -> None:
        self.encoding, self.words = encoding, _Words(encoding.bins)

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(features, passages of each text, words of each text) for runs of texts in order. A text
        without words has one passage of zeros."""
        ids: list[np.ndarray] = []
        held = 0
        for text in texts:
            if len(self.words) > CACHE_WORDS and not ids:
                self.words = _Words(self.encoding.bins)
            words = (text or "").split()
            ids.append(np.fromiter(map(self.words.__getitem__, words), np.int64, len(words)))
            held += len(words)
            if held >= CHUNK_WORDS:
                yield self._features(ids)
                ids, held = [], 0
        if ids:
            yield self._features(ids)

    def _features(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bins, size = self.encoding.bins, self.encoding.passage_words
        n_words = np.array([len(x) for x in ids], np.int64)
        n_passages = np.maximum(1, -(-n_words // size))
        first = np.concatenate([[0], np.cumsum(n_passages)[:-1]])
        total = int(n_passages.sum())
        out = np.zeros((total, self.encoding.width), np.float32)
        words = np.concatenate(ids)
        if not len(words):
            return out, n_passages, n_words
        starts = np.concatenate([[0], np.cumsum(n_words)[:-1]])
        at = np.arange(len(words)) - np.repeat(starts, n_words)
        passage = np.repeat(first, n_words) + at // size
        known = self.words.table()
        counts = np.bincount(passage, minlength=total).astype(np.float32)
        safe = np.maximum(counts, 1)
        keys = known[:, 0].astype(np.int64)[words]
        hashed = np.bincount(passage * bins + keys, minlength=total * bins)
        out[:, :bins] = np.sqrt(hashed.reshape(total, bins) / safe[:, None])
        for k in range(1, known.shape[1]):
            surface = np.bincount(passage, weights=known[words, k], minlength=total)
            out[:, bins + k - 1] = surface / safe
        pairs = np.sort(passage * (int(words.max()) + 1) + words)
        new = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        distinct = np.bincount(pairs[new] // (int(words.max()) + 1), minlength=total)
        out[:, bins + 6] = 1 - distinct / safe
        same = np.zeros(len(words), bool)
        same[1:] = (words[1:] == words[:-1]) & (passage[1:] == passage[:-1])
        out[:, bins + 7] = np.bincount(passage, weights=same, minlength=total) / safe
        out[:, bins + 8] = counts / size
        return out, n_passages, n_words


def worker_encoder(encoding: Encoding) -> PassageEncoder:
    """A worker's encoder, so that later tasks find the words of earlier ones."""
    return worker_state(encoding, PassageEncoder)
