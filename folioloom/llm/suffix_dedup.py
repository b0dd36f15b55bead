"""Suffix-array deduplication: bytes that a LENGTH-byte string covers which also starts earlier are removed.

Places at which equal strings must meet are found first (anchors, one in about thirty bytes, see repeats.py), and those
whose surroundings came before as a whole are settled by fingerprints. The surroundings of the others go to shards in
document order, and each shard keeps a logarithmic family of suffix arrays over them: a batch gets a suffix array, is
scanned against the levels for matches of LENGTH bytes, and joins the family, whose levels merge geometrically. Suffixes
are compared byte by byte. Arrays over all surroundings would shuffle five times the text, hence the fingerprints.

Nulls: a null text is empty, a null id counts as the smallest. Rows equal in id and text are one document. Texts shorter
than LENGTH bytes stay whole.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame

from .passages import Tokens, byte_values, remove

LENGTH, GRAM = 100, 32
#: A level holds the bytes of every STEP-th suffix.
STEP = 16


def encode(text: str) -> bytes:
    return text.encode()


class SuffixArray:
    """Suffixes of at least w bytes of some contexts, in order of their first w bytes, then of their places.

    text: the contexts one behind the other; first: where each begins; doc, origin: its document and the place at which
    text would have to begin there; at: the suffixes.
    """

    def __init__(self, w: int, text: np.ndarray, first: np.ndarray, doc: np.ndarray, origin: np.ndarray, at: np.ndarray):
        self.w, self.text, self.first, self.doc, self.origin, self.at = w, text, first, doc, origin, at

    @classmethod
    def build(cls, w: int, doc: np.ndarray, start: np.ndarray, data: list[bytes]) -> SuffixArray:
        size = np.array([len(x) for x in data], dtype=np.int64)
        first = np.cumsum(size) - size
        n = np.maximum(size - w + 1, 0)
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        out = cls(w, np.frombuffer(b"".join(data), dtype=np.uint8), first, doc, start - first, at)
        out.at = at[np.lexsort(out.places()[::-1])]
        out.at = out.at[np.argsort(out.keys(), kind="stable")]
        return out

    def owners(self, some=slice(None)) -> np.ndarray:
        return np.searchsorted(self.first, self.at[some], side="right") - 1

    def places(self, some=slice(None)) -> tuple[np.ndarray, np.ndarray]:
        own = self.owners(some)
        return self.doc[own], self.origin[own] + self.at[some]

    def keys(self, some=slice(None)) -> np.ndarray:
        """The first w bytes of suffixes, as strings that NumPy compares."""
        at = self.at[some]
        if not len(at):
            return np.empty(0, dtype=f"S{self.w}")
        return np.lib.stride_tricks.sliding_window_view(self.text, self.w)[at].view(f"S{self.w}").ravel()

    def find(self, keys: np.ndarray) -> np.ndarray:
        """How many suffixes come before each key: among every STEP-th suffix first, then between two of these."""
        block = np.searchsorted(self.fence, keys)
        lo, hi = np.where(block > 0, (block - 1) * STEP + 1, 0), np.minimum(block * STEP, len(self.at))
        for _ in range(STEP.bit_length()):
            mid = np.minimum((lo + hi) >> 1, len(self.at) - 1)
            less = (self.keys(mid) < keys) & (lo < hi)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, np.minimum(mid, hi))
        return lo

    @cached_property
    def fence(self) -> np.ndarray:
        return self.keys(np.arange(0, len(self.at), STEP))

    def only(self, keep: np.ndarray) -> SuffixArray:
        """Without the other suffixes, nor the contexts that have none left."""
        own = self.owners(keep)
        used, rank = np.unique(own, return_inverse=True)
        size = np.diff(np.append(self.first, len(self.text)))[used]
        first = np.cumsum(size) - size
        text = self.text[np.repeat(self.first[used] - first, size) + np.arange(size.sum())]
        return SuffixArray(self.w, text, first, self.doc[used], self.origin[used] + self.first[used] - first, first[rank] + self.at[keep] - self.first[own])

    def merged(self, new: SuffixArray) -> SuffixArray:
        """Both in one. A suffix of new that equals one of these has an earlier place (see SuffixFamily.add)."""
        to = self.find(new.keys()) + np.arange(len(new.at))
        at = np.empty(len(self.at) + len(new.at), dtype=np.int64)
        mine = np.ones(len(at), dtype=bool)
        mine[to] = False
        at[mine], at[to] = self.at, new.at + len(self.text)
        join = lambda a, b: np.concatenate((a, b))
        return SuffixArray(self.w, join(self.text, new.text), join(self.first, new.first + len(self.text)), join(self.doc, new.doc), join(self.origin, new.origin - len(self.text)), at)


class SuffixFamily:
    """A logarithmic family of suffix arrays over contexts that arrive in document order (a matcher, see passages.remove).

    Of equal suffixes the family holds the first alone, so contexts that bring nothing new leave no trace. A level merges
    with what joins it if that is as large, so a suffix is merged a logarithmic number of times.
    """

    by_gram = False

    def __init__(self, tokens: Tokens):
        self.w, self.levels = tokens.w, []

    def add(self, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        batch = SuffixArray.build(self.w, doc, pos - left, data)
        keys, (d, p) = batch.keys(), batch.places()
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
        run = np.repeat(first, np.diff(np.append(first, len(keys))))
        before = (d[run] != d) | (p[run] != p)
        new = np.zeros(len(keys), dtype=bool)
        new[first] = True
        for level in self.levels:
            to = level.find(keys[first])
            hit = np.minimum(to, len(level.at) - 1)
            same = (to < len(level.at)) & (level.keys(hit) == keys[first])
            ld, lp = (np.repeat(x, np.diff(np.append(first, len(keys)))) for x in level.places(hit))
            same_all = np.repeat(same, np.diff(np.append(first, len(keys))))
            before |= same_all & ((ld < d) | (ld == d) & (lp < p))
            # the same place met again, through another anchor, is neither new nor a repeat
            new &= ~(same_all & ((ld < d) | (ld == d) & (lp <= p)))
        owner, start = batch.owners(before), (p - pos[batch.owners()])[before]
        if new.any():
            joining = batch.only(new)
            while self.levels and len(self.levels[-1].at) <= len(joining.at):
                joining = self.levels.pop().merged(joining)
            self.levels.append(joining)
        found, at = np.unique(owner, return_inverse=True)
        lo, hi = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
        np.minimum.at(lo, at, start)
        np.maximum.at(hi, at, start)
        return found, lo, hi


def kept(text: str, ranges: np.ndarray) -> tuple[bytes, list[bytes]]:
    """The remaining bytes, and the removed runs."""
    raw, at, stay, gone = text.encode(), 0, [], []
    for lo, hi in ranges.tolist():
        stay.append(raw[at:lo])
        gone.append(raw[lo:hi])
        at = hi
    return b"".join([*stay, raw[at:]]), gone


def digest(text: str, ranges: np.ndarray) -> dict:
    rest, gone = kept(text, ranges)
    n = sum(map(len, gone))
    return {"n_bytes": len(rest) + n, "n_removed": n, "n_spans": len(gone), "kept_sha256": hashlib.sha256(rest).hexdigest()}


def spans(text: str, ranges: np.ndarray) -> dict:
    rest, _ = kept(text, ranges)
    return {"kept": rest, "spans": ranges.ravel().tolist()}


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, finish=spans, schema: str = "kept binary, spans array<long>", **columns) -> DataFrame:
    """id, the remaining bytes and the removed runs (their starts and ends in turn) of each document."""
    return remove(docs, Tokens(length, gram, 1, encode, byte_values), False, SuffixFamily, finish, schema, **columns)
