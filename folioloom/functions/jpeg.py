"""A baseline JPEG encoder over NumPy: all blocks of a page are transformed, quantised and coded together."""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: the tables of luminance and chrominance that the standard gives as typical.
LUMA = (16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99)
CHROMA = np.full((8, 8), 99)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
#: The order in which a block's values are written: along its diagonals, in turn up and down.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[sum(p) % 2 == 0]))])
_t = np.cos((2 * np.arange(8)[None, :] + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
_t[0] /= np.sqrt(2)


def quantiser(base: np.ndarray, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def code_lengths(symbols: np.ndarray) -> tuple[list[int], list[int]]:
    """A Huffman code for these symbols: how many codes there are of 1 to 16 bits, and the symbols by length. One code of
    ones alone stays free, as the format asks."""
    found, n = np.unique(symbols, return_counts=True)
    weight = {int(s): int(c) for s, c in zip(found, n)} | {-1: 0}
    trees = [(c, [s]) for s, c in weight.items()]
    length = dict.fromkeys(weight, 0)
    while len(trees) > 1:
        trees.sort(key=lambda t: (-t[0], -min(t[1])))
        (c, a), (d, b) = trees.pop(), trees.pop()
        for s in a + b:
            length[s] += 1
        trees.append((c + d, a + b))
    counts = np.bincount([max(x, 1) for x in length.values()], minlength=65).tolist()
    for i in range(64, 16, -1):  # longer codes: a pair moves up, beside a shorter code made one bit longer
        while counts[i] > 0:
            j = max(k for k in range(i - 1) if counts[k])
            counts[i] -= 2
            counts[i - 1] += 1
            counts[j] -= 1
            counts[j + 1] += 2
    last = max(i for i, c in enumerate(counts) if c)
    counts[last] -= 1  # the free code is one of the longest
    return counts[1:17], sorted((s for s in weight if s >= 0), key=lambda s: (length[s], s))


def codes(counts: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Code and length by symbol."""
    code, size, at, k = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64), 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            code[symbols[k]], size[symbols[k]] = at, bits
            at, k = at + 1, k + 1
        at <<= 1
    return code, size


def _magnitude(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of quantised blocks (n x 64, in order): block, place, symbol, extra bits and their number, in coding order."""
    dc = np.diff(blocks[:, 0], prepend=0)
    at, pos = np.nonzero(blocks[:, 1:])
    pos = pos + 1
    value = blocks[at, pos]
    before = np.where(np.concatenate(([True], at[1:] != at[:-1]))[: len(at)], 0, np.concatenate(([0], pos[:-1]))[: len(pos)])
    run = pos - before - 1
    size = _magnitude(value)
    long = np.repeat(np.arange(len(at)), run // 16)  # runs of 16 zeros have a symbol of their own
    end = np.setdiff1d(np.arange(len(blocks)), at[pos == 63])
    block = np.concatenate((np.arange(len(blocks)), at, at[long], end))
    place = np.concatenate((np.zeros(len(blocks)), pos * 2, pos[long] * 2 - 1, np.full(len(end), 200)))
    symbol = np.concatenate((_magnitude(dc), (run % 16) * 16 + size, np.full(len(long), 0xF0), np.zeros(len(end)))).astype(np.int64)
    value = np.concatenate((dc, value, np.zeros(len(long) + len(end)))).astype(np.int64)
    bits = np.where(symbol == 0xF0, 0, symbol & 15)
    return block, place, symbol, np.where(value < 0, value + (1 << bits) - 1, value), bits


def encode(img: np.ndarray, quality: int = 85) -> bytes:
    """A grey (rows, columns) or colour page as JPEG, without subsampling."""
    h, w = img.shape[:2]
    quality = min(max(quality, 1), 100)
    pad = [(0, -h % 8), (0, -w % 8)]
    if img.ndim == 2:
        planes = [img.astype(np.float32)]
    else:
        r, g, b = (img[..., c].astype(np.float32) for c in range(3))
        y = 0.299 * r + 0.587 * g + 0.114 * b
        planes = [y, (b - y) * 0.5 / 0.886 + 128, (r - y) * 0.5 / 0.701 + 128]
    tables = [quantiser(np.array(LUMA).reshape(8, 8), quality), quantiser(CHROMA, quality)]
    parts = []
    for c, plane in enumerate(planes):
        x = np.pad(plane, pad, mode="edge") - 128
        x = x.reshape(x.shape[0] // 8, 8, -1, 8).swapaxes(1, 2).reshape(-1, 8, 8)
        x = np.rint((_t @ x @ _t.T) / tables[min(c, 1)]).astype(np.int64).reshape(-1, 64)[:, ZIGZAG]
        parts.append(_symbols(x))
    out = [b"\xff\xd8\xff\xe0\x00\x10JFIF\x00\x01\x01\x00\x00\x01\x00\x01\x00\x00"]
    segment = lambda mark, data: b"\xff" + bytes([mark]) + (len(data) + 2).to_bytes(2, "big") + data
    for k in range(min(2, len(planes))):
        out.append(segment(0xDB, bytes([k]) + bytes(tables[k].ravel()[ZIGZAG].astype(np.uint8))))
    out.append(segment(0xC0, bytes([8, h >> 8, h & 255, w >> 8, w & 255, len(planes)]) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(len(planes)))))
    order = [[], [], [], []]  # code, its bits, block, place
    for k in range(min(2, len(planes))):
        mine = [c for c in range(len(planes)) if min(c, 1) == k]
        for ac in (0, 1):
            chosen = [(c, (parts[c][1] > 0) == bool(ac)) for c in mine]
            counts, symbols = code_lengths(np.concatenate([parts[c][2][m] for c, m in chosen]))
            out.append(segment(0xC4, bytes([ac << 4 | k]) + bytes(counts) + bytes(symbols)))
            code, size = codes(counts, symbols)
            for c, m in chosen:
                block, place, symbol, extra, bits = (x[m] for x in parts[c])
                order[0].append(code[symbol] << bits.astype(np.uint64) | extra.astype(np.uint64))
                order[1].append(size[symbol] + bits)
                order[2].append(block * len(planes) + c)
                order[3].append(place)
    out.append(segment(0xDA, bytes([len(planes)]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(len(planes))) + b"\x00\x3f\x00"))
    value, size, block, place = (np.concatenate(x) for x in order)
    at = np.lexsort((place, block))
    value, size = value[at], size[at]
    ends = np.cumsum(size)
    bit = np.repeat(ends, size) - np.arange(int(ends[-1])) - 1
    stream = (np.repeat(value, size) >> bit.astype(np.uint64)).astype(np.uint8) & 1
    data = np.packbits(np.concatenate((stream, np.ones(-len(stream) % 8, dtype=np.uint8)))).tobytes()
    return b"".join(out) + data.replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
