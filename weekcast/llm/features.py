"""Hashed word n-grams of whole texts, and logistic models trained on them by follow-the-regularised-leader.

Texts become sparse vectors inside Arrow batches: hashes of words are remembered per worker (bounded), and
n-grams are combined from them with array arithmetic, so a score is one gather and one sum per text.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import xxhash

CACHED_WORDS = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


class HashCache(dict):
    """64-bit hashes of (a view of) words; emptied when full."""

    def __init__(self, view: Callable[[str], str]):
        super().__init__()
        self._view = view

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh64_intdigest(self._view(word).encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = value
        return value


_DIGITS, _UPPER, _LETTERS, _RUN = (
    re.compile(p) for p in (r"\d+", r"[A-ZÀ-ÖØ-Þ]+", r"[^\W\dA]+", r"([^\w])\1+")
)


def word_shape(word: str) -> str:
    """``Osra***`` -> ``Aa*``: letters by case, digits, and runs of signs once."""
    shape = _LETTERS.sub("a", _UPPER.sub("A", _DIGITS.sub("0", word)))
    return "s:" + _RUN.sub(r"\1", shape)


def plain_word(word: str) -> str:
    return word.strip(".,;:!?\"'()[]{}*#$%&|").lower()


@dataclass(frozen=True)
class FeatureSpace:
    """Which n-grams are hashed, into how many buckets, and how they are weighed.

    ``presence``: every n-gram of a text counts once, with weight 1. Otherwise its share of the text's
    n-grams counts, times ``scale``.
    """

    views: tuple[Callable[[str], str], ...]
    buckets: int = 1 << 18
    orders: tuple[int, ...] = (1, 2)
    presence: bool = False
    scale: float = 8.0

    def caches(self) -> list[HashCache]:
        return [HashCache(v) for v in self.views]

    def indices(self, texts: Sequence[str], caches: list[HashCache]) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of all n-grams of all texts, text after text, and the number per text."""
        words = [t.split() for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        parts, owners = [], []
        mask = np.uint64(self.buckets - 1)
        for cache in caches:
            get = cache.__getitem__
            hashes = np.fromiter((h for w in words for h in map(get, w)), dtype=np.uint64, count=int(sizes.sum()))
            gram = hashes
            for order in range(1, max(self.orders) + 1):
                if order > 1:
                    gram = gram[:-1] * _MIX2 + hashes[order - 1 :]
                if order in self.orders:
                    same = owner[: len(gram)] == owner[order - 1 :] if len(gram) else np.zeros(0, bool)
                    mixed = gram[same] * _MIX
                    parts.append(((mixed >> np.uint64(29)) & mask).astype(np.int32))
                    owners.append(owner[: len(gram)][same])
        index, who = np.concatenate(parts), np.concatenate(owners)
        order = np.argsort(who, kind="stable")
        return index[order], np.bincount(who, minlength=len(texts))

    def sparse(self, texts: Sequence[str], caches) -> list[tuple[np.ndarray, np.ndarray]]:
        """(buckets, values) of each text, every bucket once."""
        if self.presence and self.orders == (1,):
            mask, out = np.uint64(self.buckets - 1), []
            for text in texts:
                words = set(text.split())
                hashes = {h for cache in caches for h in map(cache.__getitem__, words)}
                mixed = np.fromiter(hashes, dtype=np.uint64, count=len(hashes)) * _MIX
                found = np.unique(((mixed >> np.uint64(29)) & mask).astype(np.int32))
                out.append((found, np.ones(len(found))))
            return out
        index, counts = self.indices(texts, caches)
        out, at = [], 0
        for n in counts:
            found, times = np.unique(index[at : at + n], return_counts=True)
            values = np.ones(len(found)) if self.presence else times * (self.scale / max(n, 1))
            out.append((found, values))
            at += n
        return out

    def dot(self, texts: Sequence[str], caches, weights: Sequence[np.ndarray]) -> list[np.ndarray]:
        """Products of each text with several weight vectors, from one pass over the texts."""
        if self.presence:
            rows = self.sparse(texts, caches)
            return [np.array([w[i].sum(dtype=np.float64) for i, _ in rows], dtype=np.float64) for w in weights]
        words = [t.split() for t in texts]
        ends = np.cumsum([len(w) for w in words]) if words else np.zeros(0, np.int64)
        starts = ends - np.array([len(w) for w in words], dtype=np.int64)
        mask = np.uint64(self.buckets - 1)
        sums = [np.zeros(len(texts)) for _ in weights]
        total = np.zeros(len(texts))
        for cache in caches:
            get = cache.__getitem__
            count = int(ends[-1]) if len(ends) else 0
            hashes = np.fromiter((h for w in words for h in map(get, w)), dtype=np.uint64, count=count)
            gram = hashes
            for order in range(1, max(self.orders) + 1):
                if order > 1:
                    gram = gram[:-1] * _MIX2 + hashes[order - 1 :]
                if order not in self.orders:
                    continue
                last = np.maximum(ends - order + 1, starts)  # n-grams inside a text start before this
                index = ((gram * _MIX) >> np.uint64(29)) & mask
                total += last - starts
                for out, w in zip(sums, weights, strict=True):
                    running = np.concatenate([[0.0], np.cumsum(w[index], dtype=np.float64)])
                    top = len(running) - 1
                    out += running[np.minimum(last, top)] - running[np.minimum(starts, top)]
        return [s * self.scale / np.maximum(total, 1) for s in sums]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


@dataclass(frozen=True)
class Ftrl:
    """Follow-the-regularised-leader with per-coordinate rates."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.0
    epochs: int = 3

    def fit(self, rows, labels, size: int, seed: int = 7) -> np.ndarray:
        """Weights of ``size`` coordinates from sparse rows; the last coordinate is the constant."""
        z, n = np.zeros(size), np.zeros(size)

        def weights(at):
            zi = z[at]
            shrunk = np.sign(zi) * self.l1 - zi
            return np.where(np.abs(zi) <= self.l1, 0.0, shrunk / ((self.beta + np.sqrt(n[at])) / self.alpha + self.l2))

        draw = np.random.default_rng(seed)
        for _ in range(self.epochs):
            for i in draw.permutation(len(rows)):
                at, x = rows[i]
                w = weights(at)
                g = (sigmoid(float(w @ x)) - labels[i]) * x
                squares = g * g
                z[at] += g - (np.sqrt(n[at] + squares) - np.sqrt(n[at])) / self.alpha * w
                n[at] += squares
        return weights(np.arange(size)).astype(np.float32)
