"""Substring deduplication: words that a window of WINDOW words covers which also starts in an earlier document go.

Candidates come from anchors (see repeats.py, passages.py). Each shard compresses its contested contexts into an FM-index:
the Burrows-Wheeler transform of the contexts' words, reversed, in a wavelet matrix. Contexts stream through it by backward
search, all at once: for each place where a window may end, the search extends the match word by word, as long as the rows
in its interval include an earlier document, and a window repeats if the match reaches WINDOW words. Intervals above that
threshold are what is reported.

Nulls: a null text has no words, a null id counts as the smallest. Rows equal in id and text are one document. Words are
compared by 40-bit hashes within contexts whose grams share a 64-bit hash.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import WORD
from .passages import Tokens, hash_values, remove
from .words import word_hashes

WINDOW, GRAM, WIDTH = 50, 16, 5
_word = re.compile(WORD)


def encode(text: str) -> bytes:
    h, _ = word_hashes([text])
    return h.view(np.uint8).reshape(-1, 8)[:, :WIDTH].tobytes()


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes of x in order, by prefix doubling."""
    rank, k = np.unique(x, return_inverse=True)[1].astype(np.int64), 1
    while True:
        nxt = np.full(len(x), -1, dtype=np.int64)
        nxt[:-k] = rank[k:]
        key = rank * (len(x) + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        new = np.empty(len(x), dtype=np.int64)
        new[order] = np.cumsum(np.concatenate(([0], key[order][1:] != key[order][:-1])))
        rank, k = new, 2 * k
        if rank.max(initial=0) == len(x) - 1 or k >= len(x):
            return order


class WaveletMatrix:
    """Ranks of symbols (0 to size - 1) in a sequence: one bit vector a level, with counts at every word of 64 bits."""

    def __init__(self, x: np.ndarray, size: int):
        self.levels, self.bits = [], max(1, int(size - 1).bit_length())
        for b in reversed(range(self.bits)):
            one = (x >> b) & 1 == 1
            packed = np.zeros((len(x) // 64 + 1) * 8, dtype=np.uint8)
            got = np.packbits(one, bitorder="little")
            packed[: len(got)] = got
            words = packed.view(np.uint64)
            counts = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))
            self.levels.append((words, counts, int((~one).sum())))
            x = np.concatenate((x[~one], x[one]))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        return counts[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def begin(self, symbol: np.ndarray) -> np.ndarray:
        """Where each symbol's run begins in the last level."""
        at = np.zeros(len(symbol), dtype=np.int64)
        for (words, counts, zeros), b in zip(self.levels, reversed(range(self.bits))):
            r = self._ones(words, counts, at)
            at = np.where((symbol >> b) & 1 == 1, zeros + r, at - r)
        return at

    def follow(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """begin() of each symbol, plus how many of it stand before lo and before hi."""
        n = len(lo)
        at, symbol = np.concatenate((lo, hi)), np.concatenate((symbol, symbol))
        for (words, counts, zeros), b in zip(self.levels, reversed(range(self.bits))):
            r = self._ones(words, counts, at)
            at = np.where((symbol >> b) & 1 == 1, zeros + r, at - r)
        return at[:n], at[n:]


class FMIndex:
    """Backward search over a sequence of symbols above 0, in which 0 separates texts."""

    def __init__(self, x: np.ndarray, size: int, doc: np.ndarray):
        sa = suffix_array(x)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=size))))
        self.tree = WaveletMatrix(x[sa - 1], size)
        # from a symbol's run in the tree to its rows
        self.first = self.first[:size] - self.tree.begin(np.arange(size))
        # least document in every stretch of 2**k rows
        self.least = [doc[sa]]
        while 2 << (len(self.least) - 1) <= len(x):
            last, k = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(last[:-k], last[k:]))

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, z = self.tree.follow(symbol, lo, hi)
        return self.first[symbol] + a, self.first[symbol] + z

    def earliest(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least document among the rows lo to hi, which are not empty."""
        k = np.frexp(hi - lo)[1] - 1
        out = np.empty(len(lo), dtype=np.int64)
        for level in np.unique(k):
            at = np.flatnonzero(k == level)
            out[at] = np.minimum(self.least[level][lo[at]], self.least[level][hi[at] - (1 << level)])
        return out


class Shard:
    """Matches contexts, those of a gram together, by an FM-index over them (a matcher, see passages.remove)."""

    by_gram = True

    def __init__(self, tokens: Tokens):
        self.tokens = tokens

    def add(self, g: np.ndarray, doc: np.ndarray, pos: np.ndarray, left: np.ndarray, data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokens = self.tokens
        size = np.array([len(x) for x in data], dtype=np.int64) // tokens.width
        values = tokens.values(np.frombuffer(b"".join(data), dtype=np.uint8).reshape(-1, tokens.width))
        # contexts stand in one sequence, each behind a separator that no search crosses
        _, symbol = np.unique(values, return_inverse=True)
        n_symbols = int(symbol.max()) + 2
        starts = np.cumsum(size + 1) - size
        x = np.zeros(int(size.sum()) + len(data) + 1, dtype=np.int64)
        own = np.repeat(starts - np.cumsum(size) + size, size) + np.arange(size.sum())
        x[own] = symbol + 1
        _, rank = np.unique(doc, return_inverse=True)
        docs = np.full(len(x), np.iinfo(np.int32).max, dtype=np.int32)
        docs[own] = np.repeat(rank, size)
        index = FMIndex(x, n_symbols, docs)
        reach = tokens.w - tokens.k
        # nothing repeats in the first document of a gram: what holds the same window holds the same gram
        _, gram = np.unique(g, return_inverse=True)
        first = np.full(gram.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, gram, rank)
        later = np.flatnonzero(rank > first[gram])
        # one search for each place where a window may end, all at once
        who, end = np.repeat(later, reach + 1), np.tile(np.arange(tokens.w, tokens.w + reach + 1), len(later))
        keep = end <= size[who]
        who, end = who[keep], end[keep]
        a, z = np.zeros(len(who), dtype=np.int64), np.full(len(who), len(x))
        for back in range(1, tokens.w + 1):
            a, z = index.extend(x[starts[who] + end - back], a, z)
            ok = index.earliest(a, z) < rank[who]  # the context's own row is there: never empty
            who, end, a, z = who[ok], end[ok], a[ok], z[ok]
        lo_at, hi_at = np.full(len(data), np.iinfo(np.int64).max), np.full(len(data), -1)
        np.minimum.at(lo_at, who, end - tokens.w)
        np.maximum.at(hi_at, who, end - tokens.w)
        found = np.flatnonzero(hi_at >= 0)
        return found, lo_at[found] - left[found], hi_at[found] - left[found]


def kept(text: str, ranges: np.ndarray) -> list[str]:
    words, at, out = _word.findall(text), 0, []
    for lo, hi in ranges.tolist():
        out += words[at:lo]
        at = hi
    return out + words[at:]


def digest(text: str, ranges: np.ndarray) -> dict:
    rest, gone = kept(text, ranges), int((ranges[:, 1] - ranges[:, 0]).sum())
    return {"n_words": len(rest) + gone, "n_removed": gone, "kept_sha256": hashlib.sha256(" ".join(rest).encode()).hexdigest()}


def spans(text: str, ranges: np.ndarray) -> dict:
    return {"kept": " ".join(kept(text, ranges)), "spans": ranges.ravel().tolist()}


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, finish=spans, schema: str = "kept string, spans array<long>", **columns) -> DataFrame:
    """id, the remaining words and the removed runs (first and last word's end in turn) of each document."""
    return remove(docs, Tokens(window, gram, WIDTH, encode, hash_values), True, Shard, finish, schema, **columns)
