"""Flattening of photographed pages by a sampling grid: 2 x rows x columns, for each point of the flat page the place in the
photo it comes from, -1 to 1 across and down."""

from __future__ import annotations

import numpy as np

from .lines import bilinear
from .rasters import to_bytes


def remap(img: np.ndarray, grid: np.ndarray, rows: int = 256) -> np.ndarray:
    """The page, as large as the photo; places outside the photo are white."""
    h, w = img.shape[:2]
    gh, gw = grid.shape[1:]
    out, px = np.full_like(img, 255), img.astype(np.float32)
    for top in range(0, h, rows):
        y, x = np.mgrid[top : min(top + rows, h), 0:w].astype(np.float64)
        at = x * (gw - 1) / max(w - 1, 1), y * (gh - 1) / max(h - 1, 1)
        sx, sy = ((bilinear(g, *at) + 1) / 2 * (n - 1) for g, n in zip(grid, (w, h)))
        inside = (sx >= -0.5) & (sy >= -0.5) & (sx <= w - 0.5) & (sy <= h - 0.5)
        out[top : top + rows][inside] = np.stack([to_bytes(bilinear(px[..., c], sx[inside], sy[inside])) for c in range(img.shape[2])], axis=1)
    return out


def homography(flat: np.ndarray, photo: np.ndarray) -> np.ndarray | None:
    """The 3 x 3 projection that takes the points flat to photo (n x 2 each) with the least squares; None if there is none."""
    s, t, u, v = *flat.T, *photo.T
    one, zero = np.ones_like(s), np.zeros_like(s)
    rows = np.concatenate((np.stack((s, t, one, zero, zero, zero, -u * s, -u * t), axis=1), np.stack((zero, zero, zero, s, t, one, -v * s, -v * t), axis=1)))
    found, _, rank, _ = np.linalg.lstsq(rows, np.concatenate((u, v)), rcond=None)
    return np.append(found, 1.0).reshape(3, 3) if rank == 8 else None


def without_curl(grid: np.ndarray) -> np.ndarray:
    """The grid made anew from the projection that fits its border: outline and perspective stay, inner bends go."""
    gh, gw = grid.shape[1:]
    t, s = np.mgrid[0:gh, 0:gw].astype(np.float64)
    s, t = s / (gw - 1), t / (gh - 1)
    border = np.zeros((gh, gw), dtype=bool)
    border[[0, -1]] = border[:, [0, -1]] = True
    m = homography(np.stack((s[border], t[border]), axis=1), np.stack([g[border] for g in grid.astype(np.float64)], axis=1))
    if m is None:
        return grid
    u, v, d = m @ np.stack((s.ravel(), t.ravel(), np.ones(s.size)))
    return np.stack((u / d, v / d)).reshape(grid.shape).astype(np.float32)


def gutter_cut(width: int, grid: np.ndarray, gutter: int) -> tuple[int, int]:
    """Where the photo's left page ends and its right one begins, for a gutter at this column of the flattened spread: its
    outermost places in the photo, and a hundredth of the width more on either side."""
    gh, gw = grid.shape[1:]
    at = np.full(gh, gutter / max(width - 1, 1) * (gw - 1))
    x = (bilinear(grid[0], at, np.arange(gh, dtype=np.float64)) + 1) / 2 * (width - 1)
    left, right = int(x.max() + width * 0.01 + 0.5), int(max(x.min() - width * 0.01 + 0.5, 0))
    return min(max(left, 1), width), min(right, width - 1)
