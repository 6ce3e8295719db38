"""Likelihood of words as sums over all their segmentations into the pieces of an existing vocabulary.

A word is its UTF-8 bytes after one space byte, which stands for a piece's space
mark. Every piece is an edge of the lattice, and every single byte too, so each
word has a segmentation. The forward recursion runs in log space over all words
of one length at once; edges are found by a hash of each run of bytes.
"""

from __future__ import annotations

from functools import lru_cache
from math import exp, log

import numpy as np

from tessera.llm import scan
from tessera.llm.scan import U

_P = U(0x9E3779B97F4A7C15)
_BITS = 20
#: Bytes beyond which a word is walked by itself.
LONG = 96


class Pieces:
    """The vocabulary's pieces as byte strings, and a start for their probabilities.

    The vocabulary's scores order its pieces by how common they are, so the start
    is Zipf's law over that order. Ids 0 to 255 are single bytes.
    """

    def __init__(self, texts: list[str], scores: list[float]):
        order = sorted(range(len(texts)), key=lambda i: (-scores[i], i))
        seen = {bytes([i]): i for i in range(256)}
        weight = [0.02 / (len(order) + 1)] * 256
        for rank, i in enumerate(order, 1):
            b = texts[i].replace("▁", " ").encode()
            if b in seen:
                if len(b) == 1:
                    weight[seen[b]] = 1 / rank
            elif b" " not in b[1:]:
                seen[b] = len(seen)
                weight.append(1 / rank)
        self.pieces = list(seen)
        self.longest = max(map(len, self.pieces))
        p = np.array(weight)
        self.start = np.log(p / p.sum())
        with np.errstate(over="ignore"):
            h = np.array([self._hash(np.frombuffer(b, np.uint8)) for b in self.pieces], U)
        o = np.argsort(h)
        self.hash, self.id = h[o], np.arange(len(h))[o]
        self.maybe = np.zeros(1 << _BITS, bool)
        self.maybe[(h >> U(64 - _BITS)).astype(np.int64)] = True

    @staticmethod
    def _hash(b: np.ndarray) -> np.uint64:
        h = U(len(b))
        for x in b:
            h = h * _P + U(x) + U(1)
        return scan.mix(np.array([h]))[0]

    def edges(self, words: np.ndarray) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """(begin, end, rows, ids) for each place of words of one length, a row each; in order of end."""
        m, n = words.shape
        out = []
        w = words.astype(U) + U(1)
        run = np.empty((m, n), U)  # of each begin, the hash of the bytes so far
        by_end: list[list] = [[] for _ in range(n + 1)]
        for size in range(1, min(self.longest, n) + 1):
            k = n - size + 1
            run = w[:, :k].copy() if size == 1 else run[:, :k] * _P + w[:, size - 1 : size - 1 + k]
            if size == 1:
                for b in range(n):
                    by_end[b + 1].append((b, np.arange(m), words[:, b].astype(np.int64)))
                continue
            # The length goes in front of the polynomial: len * P**size.
            h = scan.mix(run + U(size * pow(int(_P), size, 1 << 64) % (1 << 64)))
            r, b = np.nonzero(self.maybe[(h >> U(64 - _BITS)).astype(np.int64)])
            if not len(r):
                continue
            x = h[r, b]
            i = np.minimum(np.searchsorted(self.hash, x), len(self.hash) - 1)
            ok = self.hash[i] == x
            r, b, i = r[ok], b[ok], self.id[i[ok]]
            order = np.argsort(b, kind="stable")
            r, b, i = r[order], b[order], i[order]
            cut = np.searchsorted(b, np.arange(k + 1))
            for at in range(k):
                if cut[at] < cut[at + 1]:
                    s = slice(cut[at], cut[at + 1])
                    by_end[at + size].append((at, r[s], i[s]))
        for end, es in enumerate(by_end):
            out += [(b, end, r, i) for b, r, i in es]
        return out

    def forward(self, words: np.ndarray, logp: np.ndarray, edges=None) -> np.ndarray:
        """(words, length + 1) log-probabilities of all segmentations of the first bytes."""
        m, n = words.shape
        a = np.full((m, n + 1), -np.inf)
        a[:, 0] = 0
        now, parts = 1, []
        for b, e, r, i in [*(edges or self.edges(words)), (0, n + 1, None, None)]:
            if e != now:
                top = np.full(m, -np.inf)
                for rr, t in parts:
                    top[rr] = np.maximum(top[rr], t)
                total = np.zeros(m)
                for rr, t in parts:
                    total[rr] += np.exp(t - top[rr])
                a[:, now] = top + np.log(total)
                now, parts = e, []
            if r is not None:
                parts.append((r, a[r, b] + logp[i]))
        return a

    def expected(self, words: np.ndarray, logp: np.ndarray, weight: np.ndarray, edges=None, forward=None) -> np.ndarray:
        """Expected uses of each piece over all segmentations, times the words' weights; a row for each column of weights, if they have columns."""
        m, n = words.shape
        edges = edges or self.edges(words)
        a = self.forward(words, logp, edges) if forward is None else forward
        z = np.full((m, n + 1), -np.inf)
        z[:, n] = 0
        rows, ids, share = [], [], []
        for b, e, r, i in reversed(edges):  # ends fall, so an end is whole before it is used
            t = logp[i] + z[r, e]
            z[r, b] = np.logaddexp(z[r, b], t)
            rows.append(r)
            ids.append(i)
            share.append(np.exp(a[r, b] + t - a[r, n]))
        rows, ids, share = np.concatenate(rows), np.concatenate(ids), np.concatenate(share)
        each = weight.reshape(m, -1).T
        out = np.array([np.bincount(ids, weights=share * w[rows], minlength=len(self.pieces)) if w.any() else np.zeros(len(self.pieces)) for w in each])
        return out if weight.ndim > 1 else out[0]

    def long_word(self, word: bytes, logp: np.ndarray) -> float:
        """Log-probability of a single long word, byte by byte."""
        known = self._index()
        n, a = len(word), [0.0]
        for e in range(1, n + 1):
            ts = [a[e - 1] + logp[word[e - 1]]]
            for b in range(max(0, e - self.longest), e - 1):
                i = known.get(word[b:e])
                if i is not None:
                    ts.append(a[b] + logp[i])
            top = max(ts)
            a.append(top + log(sum(exp(t - top) for t in ts)))
        return a[n]

    def long_expected(self, word: bytes, logp: np.ndarray, weight: float, out: np.ndarray) -> None:
        """Adds to ``out`` the expected uses of each piece in a single long word, times its weight; byte by byte."""
        known = self._index()
        n, a, edges = len(word), [0.0], []
        for e in range(1, n + 1):
            es = [(e - 1, word[e - 1])]
            for b in range(max(0, e - self.longest), e - 1):
                i = known.get(word[b:e])
                if i is not None:
                    es.append((b, i))
            edges.append(es)
            ts = [a[b] + logp[i] for b, i in es]
            top = max(ts)
            a.append(top + log(sum(exp(t - top) for t in ts)))
        # Backwards, the share of all segmentations that pass through a place goes to the edges that end there.
        share = [0.0] * n + [1.0]
        for e in range(n, 0, -1):
            for b, i in edges[e - 1]:
                s = share[e] * exp(a[b] + logp[i] - a[e])
                share[b] += s
                out[i] += weight * s

    @lru_cache(1)  # noqa: B019
    def _index(self) -> dict[bytes, int]:
        return {b: i for i, b in enumerate(self.pieces)}


def by_length(words: list[bytes], limit: int = 1 << 16):
    """(positions, matrix) for words of one length, each after its space byte; longer ones as (position, None)."""
    size = np.array([len(w) + 1 for w in words])
    order = np.argsort(size, kind="stable")
    cut = np.flatnonzero(np.diff(size[order])) + 1
    for part in np.split(order, cut):
        if not len(part):
            continue
        n = size[part[0]]
        if n > LONG:
            yield from ((np.array([i]), None) for i in part)
            continue
        for k in range(0, len(part), limit):
            at = part[k : k + limit]
            yield at, np.frombuffer(b"".join(b" " + words[i] for i in at), np.uint8).reshape(len(at), n)
