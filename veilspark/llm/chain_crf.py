"""Linear-chain conditional random field over words, in numpy.

Chains are sentences: a chain ends after a word that closes with ``.``, ``!``
or ``?`` and at the end of its text. All chains of a batch advance one word at
a time together (forward and backward), so a step costs one small matrix
product. A chain of more than ``SEGMENT`` words is worked on in segments that
advance together too: the product of a segment's step matrices carries the
state over it, so that the result is that of the whole chain and a long text
needs no long loop.
"""

from __future__ import annotations

import re
import zlib

import numpy as np

from .words import Texts

SEGMENT = 128
_CLOSES = np.zeros(256, dtype=bool)
_CLOSES[[ord(c) for c in ".!?"]] = True
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(word: bytes) -> str:
    """The word's letters in lower case: what remains without digits, marks and punctuation."""
    return _NOT_LETTERS.sub("", word.decode().lower())


def hashed(features: list[str], size: int) -> list[int]:
    return [zlib.crc32(f.encode()) % size for f in features]


def chains(texts: Texts, ends: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each chain."""
    n = len(ends)
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    new = np.empty(n, dtype=bool)
    new[0] = True
    new[1:] = _CLOSES[texts.data[ends[:-1] - 1]] | (rows[1:] != rows[:-1])
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, n))


def segments(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and place within its chain of each segment, chain by chain."""
    n = -(-lengths // SEGMENT)
    place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    first = np.repeat(starts, n) + place * SEGMENT
    return first, np.minimum(np.repeat(starts + lengths, n) - first, SEGMENT), place


class ChainCRF:
    """Emission weights of hashed features, start and transition scores of ``k`` states."""

    def __init__(self, k: int, features: int):
        self.k, self.features = k, features
        self.weights = np.zeros((features, k), dtype=np.float64)
        self.start = np.zeros(k)
        self.move = np.zeros((k, k))

    def marginals(self, scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                  counts: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State probabilities of every word given its chain; with ``counts`` also the
        expected start states and transitions (sums over chains)."""
        chain_starts = starts
        starts, lengths, place = segments(starts, lengths)
        order = np.argsort(-lengths, kind="stable")
        first, size = starts[order], lengths[order]
        longest = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # segments with more than t words
        e = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        a = np.exp(self.move)
        before, after, joined = self._carried(e, a, starts, lengths, place)
        alpha = np.empty_like(e)
        head = np.where((place > 0)[:, None], before @ a, np.exp(self.start)[None, :])
        now = head[order] * e[first]
        now /= now.sum(axis=1, keepdims=True)
        alpha[first] = now
        for t in range(1, longest):
            at = first[:alive[t]] + t
            now = (now[:alive[t]] @ a) * e[at]
            now /= now.sum(axis=1, keepdims=True)
            alpha[at] = now
        beta = np.ones_like(e)
        beta[starts + lengths - 1] = after
        pairs = np.zeros((self.k, self.k))

        def count(at: np.ndarray) -> None:
            nonlocal pairs
            joint = alpha[at - 1][:, :, None] * a[None] * (e[at] * beta[at])[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        for t in range(longest - 1, 0, -1):
            at = first[:alive[t]] + t
            if counts:
                count(at)
            left = (e[at] * beta[at]) @ a.T
            beta[at - 1] = left / left.sum(axis=1, keepdims=True)
        if counts and len(joined):
            count(starts[joined])
        post = alpha * beta
        post /= post.sum(axis=1, keepdims=True)
        return post, post[chain_starts].sum(axis=0) if counts else self.start, pairs

    def _carried(self, e: np.ndarray, a: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
                 place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: the forward state of the word before it, the backward state of its last word; and the
        segments that continue a chain. Ones where the chain begins or ends."""
        before, after = np.ones((len(starts), self.k)), np.ones((len(starts), self.k))
        joined = np.flatnonzero(place > 0)
        if not len(joined):
            return before, after, joined
        # the segments of long chains: each one's product of step matrices (the first word of a chain has its start)
        long = np.union1d(joined, joined - 1)
        at, size = starts[long], lengths[long]
        product = np.where((place[long] > 0)[:, None, None], a[None], np.exp(self.start)[None, None, :]) * e[at][:, None, :]
        product /= product.sum(axis=(1, 2), keepdims=True)
        for t in range(1, int(size.max())):
            live = np.flatnonzero(size > t)
            step = (product[live] @ a) * e[at[live] + t][:, None, :]
            product[live] = step / step.sum(axis=(1, 2), keepdims=True)
        row = np.full(len(starts), -1)
        row[long] = np.arange(len(long))
        by_place = np.argsort(place[joined], kind="stable")
        cuts = np.searchsorted(place[joined][by_place], np.arange(1, int(place.max()) + 2))
        waves = [joined[by_place[x:y]] for x, y in zip(cuts, cuts[1:], strict=False)]
        for wave in waves:  # the k-th segments of all long chains together
            state = (before[wave - 1][:, None, :] @ product[row[wave - 1]])[:, 0]
            before[wave] = state / state.sum(axis=1, keepdims=True)
        for wave in reversed(waves):
            state = (product[row[wave]] @ after[wave][:, :, None])[:, :, 0]
            after[wave - 1] = state / state.sum(axis=1, keepdims=True)
        return before, after, joined

    def fit(self, flat: np.ndarray, sizes: np.ndarray, labels: np.ndarray, starts: np.ndarray, lengths: np.ndarray,
            rounds: int = 12, rate: float = 0.5, decay: float = 1e-4, counted: bool = False) -> ChainCRF:
        """Maximise the conditional likelihood of ``labels`` (Adagrad on whole passes).

        ``flat`` holds the feature numbers of all words one after the other and ``sizes`` how many each has.
        With ``counted``, start and transition scores begin at the logarithms of their shares among the labels.
        """
        word = np.repeat(np.arange(len(sizes)), sizes)
        gold = np.zeros((len(sizes), self.k))
        gold[np.arange(len(sizes)), labels] = 1
        inside = np.ones(len(sizes), dtype=bool)
        inside[starts] = False
        inner = np.flatnonzero(inside)
        gold_start = gold[starts].sum(axis=0)
        gold_pairs = np.zeros((self.k, self.k))
        np.add.at(gold_pairs, (labels[inner - 1], labels[inner]), 1)
        if counted:
            self.start = np.log((gold_start + 1) / (gold_start + 1).sum())
            self.move = np.log((gold_pairs + 1) / (gold_pairs + 1).sum(axis=1, keepdims=True))
        seen = np.bincount(flat, minlength=self.features)[:, None] + 1.0
        square_w, square_s, square_m = np.full_like(self.weights, 1e-8), np.full(self.k, 1e-8), np.full((self.k, self.k), 1e-8)
        for _ in range(rounds):
            scores = np.zeros((len(sizes), self.k))
            for j in range(self.k):
                scores[:, j] = np.bincount(word, weights=self.weights[flat, j], minlength=len(sizes))
            post, start, pairs = self.marginals(scores, starts, lengths, counts=True)
            gap = gold - post
            step = np.stack([np.bincount(flat, weights=gap[word, j], minlength=self.features) for j in range(self.k)], axis=1)
            step = step / np.sqrt(seen) - decay * self.weights
            square_w += step ** 2
            self.weights += rate * step / np.sqrt(square_w)
            for own, grad, square in ((self.start, (gold_start - start) / len(starts), square_s),
                                      (self.move, (gold_pairs - pairs) / max(1, len(inner)), square_m)):
                square += grad ** 2
                own += rate * grad / np.sqrt(square)
        self.weights = self.weights.astype(np.float32)
        return self
