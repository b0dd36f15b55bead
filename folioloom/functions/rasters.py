"""Kernels over one page's raster, as NumPy arrays: grey pages are (rows, columns), colour pages have three channels. They run
inside Spark tasks, one page at a time (see operators/convert.py)."""

from __future__ import annotations

import numpy as np


def grey(img: np.ndarray) -> np.ndarray:
    """Integer luma (Rec. 709 weights in ten thousandths)."""
    return ((img.astype(np.uint32) * np.array([2126, 7152, 722], dtype=np.uint32)).sum(axis=2) // 10000).astype(np.uint8)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0)


def _along(img: np.ndarray, size: int, kernel, support: float) -> np.ndarray:
    """Rows resampled to size rows: each one a weighted mean of those that the kernel, widened when shrinking, covers."""
    n = img.shape[0]
    ratio = n / size
    wide = max(ratio, 1.0)
    centre = (np.arange(size) + 0.5) * ratio
    low = np.clip(np.floor(centre - support * wide), 0, n - 1).astype(np.int64)
    high = np.clip(np.ceil(centre + support * wide), low + 1, n).astype(np.int64)
    taps = low[:, None] + np.arange(int((high - low).max()))
    w = np.where(taps < high[:, None], kernel((taps - (centre - 0.5)[:, None]) / wide), 0.0)
    w = (w / w.sum(axis=1, keepdims=True)).astype(np.float32)
    out = np.zeros((size, *img.shape[1:]), dtype=np.float32)
    for k in range(taps.shape[1]):
        out += w[:, k].reshape(-1, *[1] * (img.ndim - 1)) * img[np.minimum(taps[:, k], n - 1)]
    return out


def to_bytes(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)


def resize(img: np.ndarray, width: int, height: int, smooth: bool = True) -> np.ndarray:
    """smooth: by a triangle; else by a Lanczos kernel of three lobes."""
    kernel, support = (_triangle, 1.0) if smooth else (_lanczos, 3.0)
    tall = _along(img, height, kernel, support)
    return to_bytes(_along(tall.swapaxes(0, 1), width, kernel, support).swapaxes(0, 1))


def _scaled(n: int, s: float) -> int:
    return max(1, int(n * s + 0.5))


def shrink(img: np.ndarray, most: int) -> tuple[np.ndarray, float]:
    """The page with its longer side at most so long, and the scale of its width."""
    h, w = img.shape[:2]
    if max(h, w) <= most:
        return img, 1.0
    s = most / max(h, w)
    small = resize(img, _scaled(w, s), _scaled(h, s))
    return small, small.shape[1] / w


def fit(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """The page as large as a box allows."""
    h, w = img.shape[:2]
    s = min(width / w, height / h)
    size = (_scaled(w, s), _scaled(h, s))
    return img if size == (w, h) else resize(img, *size, smooth=False)


def block_sums(img: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the pixels within r of each, as far as the page goes."""
    h, w = img.shape
    total = np.zeros((h + 1, w + 1), dtype=np.int64)
    total[1:, 1:] = img.astype(np.int64).cumsum(axis=0).cumsum(axis=1)
    y0, y1 = np.maximum(np.arange(h) - r, 0), np.minimum(np.arange(h) + r, h - 1) + 1
    x0, x1 = np.maximum(np.arange(w) - r, 0), np.minimum(np.arange(w) + r, w - 1) + 1
    sums = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    return sums, (y1 - y0)[:, None] * (x1 - x0)[None, :]


def local_ink(img: np.ndarray, c: float, least: int = 15) -> np.ndarray:
    """Pixels darker, by c or more, than the mean of a block of a thirtieth of the page around them."""
    block = max((min(img.shape) // 30) | 1, least)
    sums, n = block_sums(img, block // 2)
    return img <= sums / n - c


def otsu_level(img: np.ndarray) -> int:
    """The grey level whose split has the largest variance between classes, the first one of a tie, of those that occur."""
    n = np.bincount(img.ravel(), minlength=256)
    w0, s0 = np.cumsum(n), np.cumsum(n * np.arange(256))
    w1 = w0[-1] - w0
    # w0 * w1 * (mean0 - mean1)**2, without fractions but for the last division: ties stay ties
    gap = (s0 * w1 - (s0[-1] - s0) * w0).astype(np.float64)
    v = np.round(gap * gap / np.maximum(w0 * w1, 1), 6)
    return int(np.where(n > 0, v, -1).argmax())


def max_filter(img: np.ndarray, r: int) -> np.ndarray:
    """The largest value within r of each pixel in both directions."""
    for axis in (0, 1):
        pad = np.pad(img, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        img = np.lib.stride_tricks.sliding_window_view(pad, 2 * r + 1, axis=axis).max(axis=-1)
    return img


def blur(x: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur; edges are repeated."""
    if sigma <= 0 or not x.size:
        return x
    r = int(np.ceil(3 * sigma))
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    for axis in (1, 0):
        n = x.shape[axis]
        x = sum(w * np.take(x, np.clip(np.arange(n) + d, 0, n - 1), axis=axis).astype(np.float64) for d, w in zip(range(-r, r + 1), k / k.sum())).astype(np.float32)
    return x


def even_light(img: np.ndarray, most: int = 800, text: float = 0.012, smooth: float = 0.02, white: int = 235) -> np.ndarray:
    """Every channel divided by its paper: the brightest of the surroundings, blurred. Values from white up become 255."""
    out = np.empty_like(img)
    for c in range(img.shape[2]):
        small, _ = shrink(img[..., c], most)
        side = max(small.shape)
        paper = max_filter(small, max(2, int(side * text + 0.5)))
        paper = np.maximum(to_bytes(blur(paper.astype(np.float32), side * smooth)), 1)
        if paper.shape != img.shape[:2]:
            paper = resize(paper, img.shape[1], img.shape[0])
        v = img[..., c].astype(np.float32) * np.float32(255) / np.maximum(paper.astype(np.float32), np.float32(16))
        out[..., c] = to_bytes(v * np.float32(255) / np.float32(max(1, white)))
    return out


def _smoothed(v: np.ndarray, r: int) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(v)))
    lo, hi = np.maximum(np.arange(len(v)) - r, 0), np.minimum(np.arange(len(v)) + r, len(v) - 1) + 1
    return (total[hi] - total[lo]) / (hi - lo)


def gutter(img: np.ndarray, half_width: float = 0.15) -> int | None:
    """The column between two pages: empty of ink, darker than its surroundings, near the middle. Top and bottom tenths do
    not count; the first column wins a tie."""
    small, scale = shrink(grey(img), 1200)
    h, w = small.shape
    rows = slice(h // 10, h - h // 10)
    ink, light = (_smoothed(x[rows].mean(axis=0), max(w // 100, 2)) for x in (local_ink(small, 15), small))
    wide = _smoothed(small[rows].mean(axis=0), w // 15)
    x = np.arange(int((0.5 - half_width) * w), int((0.5 + half_width) * w))
    if not len(x):
        return None
    empty = 1 - ink[x] / max(float(ink[x].max()), 1e-9)
    dark = np.clip((wide[x] - light[x]) / 40, 0, 1)
    score = (empty + dark) * (1 - np.abs(x / w - 0.5) / half_width * 0.3)
    return int((int(x[np.round(score, 9).argmax()]) + 0.5) / scale + 0.5)


def skew(img: np.ndarray, most: float = 5.0) -> float | None:
    """The angle (degrees, clockwise) under which projected ink is sharpest, over lines or columns; None for too little ink."""
    small, _ = shrink(grey(img), 1200)
    h, w = small.shape
    ink = local_ink(small, 10) & (small <= otsu_level(small))
    by, bx = h * 3 // 100, w * 3 // 100
    y, x = np.nonzero(ink[by : h - by, bx : w - bx])
    if len(x) < 500:
        return None
    x, y = x + bx - w / 2, y + by - h / 2
    size = int(np.hypot(w, h)) + 2

    def best(upright: bool) -> tuple[float, float]:
        def score(degrees: float) -> float:
            s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
            at = ((x * c + y * s if upright else y * c - x * s) + size / 2).astype(np.int64)
            return float((np.bincount(at, minlength=size).astype(np.float64) ** 2).sum())

        coarse = -most + 0.25 * np.arange(int(2 * most / 0.25 + 1e-6) + 1)
        scores = [score(d) for d in coarse]
        centre = float(coarse[int(np.argmax(scores))])
        fine = centre - 0.25 + 0.02 * np.arange(26)
        near = [score(d) for d in fine]
        top, angle = max(scores), centre
        if max(near) > top:
            top, angle = max(near), float(fine[int(np.argmax(near))])
        return angle, top / max(float(np.mean(scores)), 1.0)

    (level, a), (upright, b) = best(False), best(True)
    return upright if b > 1.1 * a else level


def warp(img: np.ndarray, width: int, height: int, source, repeat: bool, rows: int = 256) -> np.ndarray:
    """A page of this size whose pixels come, by cubic interpolation, from source(x, y) in img. What lies outside repeats
    the edge or is white."""
    h, w = img.shape[:2]
    out, px = np.full((height, width, img.shape[2]), 255, dtype=np.uint8), img.astype(np.float32)

    def cubic(p, t):
        return p[1] + 0.5 * t * (p[2] - p[0] + t * (2 * p[0] - 5 * p[1] + 4 * p[2] - p[3] + t * (3 * (p[1] - p[2]) + p[3] - p[0])))

    for top in range(0, height, rows):
        y, x = np.mgrid[top : min(top + rows, height), 0:width].astype(np.float32)
        sx, sy = source(x, y)
        x0, y0 = np.floor(sx).astype(np.int64) - 1, np.floor(sy).astype(np.int64) - 1
        inside = np.full(x0.shape, True) if repeat else (x0 >= 0) & (y0 >= 0) & (x0 + 3 < w) & (y0 + 3 < h)
        fx, fy = ((v - np.floor(v))[inside][:, None].astype(np.float32) for v in (sx, sy))
        xs, ys = ([np.clip(v[inside] + i, 0, n - 1) for i in range(4)] for v, n in ((x0, w), (y0, h)))
        out[top : top + rows][inside] = to_bytes(cubic([cubic([px[b, a] for a in xs], fx) for b in ys], fy))
    return out


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned clockwise about its centre."""
    h, w = img.shape[:2]
    s, c = np.sin(np.radians(degrees)), np.cos(np.radians(degrees))
    back = lambda x, y: (c * (x - w / 2) + s * (y - h / 2) + w / 2, c * (y - h / 2) - s * (x - w / 2) + h / 2)
    return warp(img, w, h, back, False)


def deskew(img: np.ndarray, least: float = 0.05) -> tuple[np.ndarray, float | None, bool]:
    """The page upright, the angle found and whether it was turned."""
    angle = skew(img)
    if angle is None or abs(angle) < least:
        return img, angle, False
    return rotate(img, -angle), angle, True


def runs(mask: np.ndarray) -> tuple[np.ndarray, ...]:
    """row, start, end and component of each run of pixels along a row, and left, top, width, height and area of each
    component: pixels touch at their corners too."""
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
    n, span = len(row), mask.shape[1] + 2
    # a run touches those of the row above that begin before its end and end behind its start
    lo = np.searchsorted(row * span + end, (row - 1) * span + start)
    hi = np.searchsorted(row * span + start, (row - 1) * span + end, side="right")
    many = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(n), many)
    b = np.repeat(lo, many) + np.arange(len(a)) - np.repeat(np.cumsum(many) - many, many)
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new[label]
    _, of = np.unique(label, return_inverse=True)
    k = int(of.max()) + 1 if n else 0
    left, top, right, bottom = np.full(k, span), np.full(k, mask.shape[0]), np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
    np.minimum.at(left, of, start)
    np.minimum.at(top, of, row)
    np.maximum.at(right, of, end)
    np.maximum.at(bottom, of, row + 1)
    area = np.bincount(of, weights=end - start, minlength=k).astype(np.int64)
    return row, start, end, of, np.stack((left, top, right - left, bottom - top, area), axis=1)


def components(mask: np.ndarray) -> np.ndarray:
    return runs(mask)[4]


def close_across(mask: np.ndarray, width: int) -> np.ndarray:
    """Dilation along the rows over [x - a, x - a + width - 1], a being half the width, then the mirrored erosion; what lies
    outside the page is ignored."""
    width = max(width, 1)
    a, n = width // 2, mask.shape[1]

    def count(m, before, behind):
        total = np.pad(np.cumsum(m, axis=1, dtype=np.int32), ((0, 0), (1, 0)))
        lo, hi = np.maximum(np.arange(n) - before, 0), np.minimum(np.arange(n) + behind, n - 1) + 1
        return total[:, hi] - total[:, lo], hi - lo

    wide = count(mask, a, width - 1 - a)[0] > 0
    found, of = count(wide, width - 1 - a, a)
    return found == of


def content_box(img: np.ndarray, ink_below: int = 160) -> tuple[int, int, int, int] | None:
    """x, y, width and height of what is printed: all components but specks, those that touch the outer 1.5 per cent, and
    tall streaks near the sides."""
    small, scale = shrink(grey(img), 1000)
    h, w = small.shape
    c = components(small < ink_below)
    left, top, width, height, area = c.T
    bx, by = int(np.ceil(w * 0.015)), int(np.ceil(h * 0.015))
    touches = (left < bx) | (top < by) | (left + width > w - bx) | (top + height > h - by)
    streak = ((left + width < w * 12 // 100) | (left > w * 88 // 100)) & (height > width * 15)
    c = c[(area >= 3) & ~touches & ~streak]
    if not len(c):
        return None
    x0, y0 = (int(np.floor(v / scale)) for v in (c[:, 0].min(), c[:, 1].min()))
    x1, y1 = (min(int(np.ceil(v / scale)), n) for v, n in (((c[:, 0] + c[:, 2]).max(), img.shape[1]), ((c[:, 1] + c[:, 3]).max(), img.shape[0])))
    return x0, y0, x1 - x0, y1 - y0


def fill_outside(img: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """White around the box and a margin of a hundredth of its shorter side, 4 pixels at least."""
    x, y, w, h = box
    pad = max(min(w, h) // 100, 4)
    out = np.full_like(img, 255)
    part = (slice(max(y - pad, 0), y + h + pad), slice(max(x - pad, 0), x + w + pad))
    out[part] = img[part]
    return out


def crop(img: np.ndarray, ox: int, oy: int, width: int, height: int) -> np.ndarray:
    """The part from (ox, oy); white where it leaves the page."""
    out = np.full((height, width, *img.shape[2:]), 255, dtype=np.uint8)
    part = img[max(oy, 0) : max(oy + height, 0), max(ox, 0) : max(ox + width, 0)]
    y, x = max(-oy, 0), max(-ox, 0)
    out[y : y + part.shape[0], x : x + part.shape[1]] = part
    return out


def is_grey(img: np.ndarray, stride: int = 7, tolerance: int = 40, share: float = 0.002) -> bool:
    px = img.reshape(-1, 3)[::stride].astype(np.int16)
    return not len(px) or bool(((px.max(axis=1) - px.min(axis=1)) > tolerance).sum() < len(px) * share)
