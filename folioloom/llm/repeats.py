"""Repeated passages: the sparse anchors that find every repeated window of tokens without listing all windows.

A window of W tokens holds W - K + 1 grams of K tokens. Grams whose hash is least in some window are anchors, so every
window has one, at the same place wherever the window occurs: equal windows meet at equal anchors. About 2 in W - K + 2
grams are anchors. The context of an anchor is all that windows around it can hold, W - K tokens before its gram and behind.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            a = np.full(n + (1 << 18), b, dtype=np.uint64)
            a[0] = 1
            _powers[i] = np.multiply.accumulate(a)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of any run of tokens in O(1): token values are 64-bit."""

    def __init__(self, tokens: np.ndarray):
        up, self.down = powers(len(tokens) + 1)
        self.sums = np.zeros(len(tokens) + 1, dtype=np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, lo, hi) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])


def _sliding(a: np.ndarray, w: int, f) -> np.ndarray:
    """f over a[i : i + w] for each i with a whole window, by blocks of w."""
    n = len(a) - w + 1
    blocks = -(-len(a) // w)
    b = np.full(blocks * w, a[-1], dtype=a.dtype)
    b[: len(a)] = a
    b = b.reshape(blocks, w)
    ahead = f.accumulate(b, axis=1).ravel()
    back = f.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(back[:n], ahead[w - 1 : w - 1 + n])


def gram_minima(h: Hashes, w: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every gram, and the least in every window of w tokens, of which there is one at least."""
    n = len(h.sums) - 1
    grams = h(np.arange(n - k + 1), np.arange(k, n + 1)) | np.uint64(1)
    return grams, _sliding(grams, w - k + 1, np.minimum)


def anchors(h: Hashes, starts: np.ndarray, lens: np.ndarray, w: int, k: int) -> np.ndarray:
    """Places of the anchors, for texts of lens tokens that begin at starts, one behind the other."""
    n = len(h.sums) - 1
    span = w - k + 1
    if n < w:
        return np.empty(0, dtype=np.int64)
    grams, least = gram_minima(h, w, k)
    # windows that would cross the end of a text do not count
    whole = np.zeros(n + 1, dtype=np.int32)
    long = lens >= w
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, starts[long] + lens[long] - w + 1, -1)
    least[np.cumsum(whole)[: len(least)] == 0] = 0
    edge = np.zeros(span - 1, dtype=np.uint64)
    most = _sliding(np.concatenate((edge, least, edge)), span, np.maximum)
    return np.flatnonzero(most == grams)


class LevelFamily:
    """A logarithmic family of sorted arrays over anchors that arrive in document order.

    A batch becomes an array of its own (the anchored suffixes, ordered by the fingerprint of their gram and context),
    is scanned against every level for suffixes that came before, and joins the family; levels merge as long as the last is
    no larger than what joins it, so an entry is merged a logarithmic number of times.
    """

    def __init__(self, other_document: bool):
        self.other, self.levels = other_document, []

    def add(self, g: np.ndarray, ctx: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Which of these anchors had their gram and context before: at all, or in a document before their own. The
        others join the family. A repeated row does not come before itself."""
        f = mix(g + np.uint64(31) * ctx)
        order = np.argsort(f, kind="stable")
        f, g, ctx, doc, pos = (x[order] for x in (f, g, ctx, doc, pos))
        first = np.flatnonzero(np.concatenate(([True], (f[1:] != f[:-1]) | (ctx[1:] != ctx[:-1])))) if len(f) else np.empty(0, dtype=np.int64)
        run = np.repeat(first, np.diff(np.append(first, len(f))))
        before = doc[run] < doc if self.other else (doc[run] != doc) | (pos[run] != pos)
        for lf, _, lc, ld, lp in self.levels:
            at = np.minimum(np.searchsorted(lf, f), len(lf) - 1)
            before |= (lf[at] == f) & (lc[at] == ctx) & ((ld[at] < doc) if self.other else (ld[at] != doc) | (lp[at] != pos))
        new = tuple(x[~before] for x in (f, g, ctx, doc, pos))
        while self.levels and len(self.levels[-1][0]) <= len(new[0]):
            new = self._merge(self.levels.pop(), new)
        if len(new[0]):
            self.levels.append(new)
        out = np.empty(len(f), dtype=bool)
        out[order] = before
        return out

    @staticmethod
    def _merge(a: tuple, b: tuple) -> tuple:
        both = tuple(np.concatenate(x) for x in zip(a, b))
        order = np.argsort(both[0], kind="stable")
        return tuple(x[order] for x in both)

    def entries(self) -> tuple:
        """g, ctx, doc and pos of all entries."""
        out = self.levels[0] if self.levels else tuple(np.empty(0, dtype=t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.int64))
        for level in self.levels[1:]:
            out = self._merge(out, level)
        return out[1:]
