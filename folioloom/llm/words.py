"""Hashes of the words of many texts at once, without a Python object for each word."""

from __future__ import annotations

import numpy as np

from .repeats import Hashes

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = np.random.default_rng(11).integers(0, 2**64, 256, dtype=np.uint64)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
#: Bytes of text that are hashed at once.
PART = 1 << 20


def word_hashes(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of all texts, in order, and the number of words of each text."""
    raw = [t.encode() for t in texts]
    buffer = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    if not len(buffer):
        return np.empty(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    space = _SPACE[buffer]
    begin = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    end = np.flatnonzero(space & ~np.concatenate(([True], space[:-1])))
    ends = np.cumsum([len(r) + 1 for r in raw])
    n = np.searchsorted(begin, ends)
    return Hashes((_LOWER if lower else _BYTES)[buffer])(begin, end), np.diff(n, prepend=0)


def parts(texts: list[str], size: int = PART):
    """The texts in stretches of about size characters, as pairs of places."""
    lo, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t)
        if n >= size:
            yield lo, i + 1
            lo, n = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
