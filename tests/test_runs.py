"""Ink as runs: components, closing, skew, against pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.functions import rasters
from folioloom.operators import runs, skew

SCHEMA = "page_id long, x int, y int"


def pixels(spark, masks):
    return spark.createDataFrame([(i, int(x), int(y)) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(m))], SCHEMA)


def boxes(df):
    return sorted(tuple(map(int, r)) for r in df.select("page_id", "left", "top", "width", "height", "area").collect())


def spiral(n):
    """A path one pixel wide that winds to the middle: one component of many runs."""
    m = np.zeros((n, n), dtype=bool)
    y = x = 0
    dy, dx, left, right, top, bottom = 0, 1, 0, n - 1, 0, n - 1
    while left <= right and top <= bottom:
        m[y, x] = True
        if dx == 1 and x == right:
            dy, dx, top = 1, 0, top + 2
        elif dy == 1 and y == bottom:
            dy, dx, right = 0, -1, right - 2
        elif dx == -1 and x == left:
            dy, dx, bottom = -1, 0, bottom - 2
        elif dy == -1 and y == top:
            dy, dx, left = 0, 1, left + 2
        y, x = y + dy, x + dx
    return m


def test_components_equal_those_of_rasters(spark):
    r = np.random.default_rng(2)
    masks = [r.random((40, 60)) < p for p in (0.05, 0.35, 0.6, 0.95)] + [np.ones((3, 200), dtype=bool)]
    df = pixels(spark, masks)
    want = sorted((i, *map(int, c)) for i, m in enumerate(masks) for c in rasters.components(m).tolist())
    assert boxes(runs.components(runs.runs(df.unionByName(df)))) == want
    assert runs.components(runs.runs(df.limit(0))).count() == 0


def test_rounds_grow_with_the_logarithm(spark):
    counts = {}
    for n in (16, 64, 128):
        got, rounds = runs.labelled(runs.runs(pixels(spark, [spiral(n)])))
        assert got.select("label").distinct().count() == 1
        counts[n] = got.count(), rounds
    assert counts[128][0] > 3000 and counts[128][1] <= 3 + np.log2(counts[128][0]) and counts[128][1] - counts[16][1] <= 6


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_closing_equals_that_of_pixels(spark, width):
    r = np.random.default_rng(width)
    masks = [r.random((12, 30)) < p for p in (0.03, 0.15, 0.5)]
    sizes = spark.createDataFrame([(i, 30) for i in range(3)], "page_id long, w int")
    got = runs.pixels(runs.closed(runs.runs(pixels(spark, masks)), sizes, width))
    want = {(i, x, y) for i, m in enumerate(masks) for y, x in zip(*np.nonzero(rasters.close_across(m, width)))}
    assert {(a.page_id, a.x, a.y) for a in got.collect()} == want


def test_characters_content_and_boxes(spark):
    rows = [(1, 10, 10, 6, 8, 30), (1, 30, 10, 6, 9, 30), (1, 50, 10, 2, 2, 4), (1, 0, 50, 9, 9, 40), (1, 60, 20, 70, 3, 90), (1, 90, 5, 1, 60, 60), (1, 40, 40, 1, 2, 2)]
    parts = spark.createDataFrame([(i, k, *r[1:]) for k, (i, *r) in enumerate([(x[0], *x) for x in rows])], "page_id long, label long, left int, top int, width int, height int, area int")
    w, h = F.lit(100), F.lit(100)
    chars = runs.characters(parts, w, h)
    assert {r.label for r in chars.collect()} == {2} and runs.character_heights(chars).first().n == 0
    chars = runs.characters(parts, F.lit(200), F.lit(200))
    assert {r.label for r in chars.collect()} == {0, 1, 2, 3} and tuple(runs.character_heights(chars).first()) == (1, 3, 9)
    inside = runs.content(parts, w, h)
    assert {r.label for r in inside.collect()} == {0, 1, 2}
    assert tuple(runs.content_box(inside, F.lit(0.5), F.lit(199), F.lit(300)).first()) == (1, 20, 20, 84, 18)


def scores_by_pixel(points, w, h, down, deg):
    t = np.radians(deg)
    x, y = points[:, 0] - w / 2, points[:, 1] - h / 2
    v = x * np.cos(t) + y * np.sin(t) if down else y * np.cos(t) - x * np.sin(t)
    size = int(np.hypot(w, h)) + 2
    i = (v + size / 2).astype(int)
    return int((np.bincount(i[i < size]).astype(np.int64) ** 2).sum())


def test_scores_of_runs_equal_those_of_pixels(spark):
    r = np.random.default_rng(4)
    masks = [r.random((50, 70)) < p for p in (0.1, 0.5, 0.9)]
    ink = skew.inner(pixels(spark, masks), F.lit(70), F.lit(50))
    degs = [-5.0, -1.37, 0.0, 0.02, 2.5]
    got = {(a.page_id, a.axis, a.deg): a.score for a in skew.scores(skew.lines_of(ink).withColumn("deg", F.explode(F.array(*map(F.lit, degs))))).collect()}
    for i, m in enumerate(masks):
        pts = np.array([(x, y) for y, x in zip(*np.nonzero(m)) if 2 <= x < 68 and 1 <= y < 49])
        for deg in degs:
            assert got[i, "h", deg] == scores_by_pixel(pts, 70, 50, False, deg) and got[i, "v", deg] == scores_by_pixel(pts, 70, 50, True, deg)


def test_skew_of_pages_of_lines(spark):
    h, w = 300, 220

    def page(angle, down=False):
        y, x = np.mgrid[0:h, 0:w]
        t = np.radians(angle)
        v = (x - w / 2) * np.cos(t) + (y - h / 2) * np.sin(t) if down else (y - h / 2) * np.cos(t) - (x - w / 2) * np.sin(t)
        return (np.mod(v, 14) < 4) & (x > 20) & (x < 200) & (y > 20) & (y < 280)

    masks = [page(2.0), page(-1.5), page(0.0), page(3.1, True), np.zeros((h, w), dtype=bool)]
    masks[4][100:110, 100:140] = True  # too little ink
    got = {r.page_id: r for r in skew.skew(pixels(spark, masks), F.lit(w), F.lit(h)).collect()}
    assert [abs(got[i].angle - a) < 0.15 for i, a in enumerate((2.0, -1.5, 0.0, 3.1))] == [True] * 4
    assert got[4].angle is None and got[4].n == 400 and got[3].down > got[3].across * 1.1
    # of equal scores the smaller angle wins: a block that looks the same at every angle searched
    dot = np.zeros((60, 60), dtype=bool)
    dot[30, 30] = True
    assert skew.skew(pixels(spark, [dot]), F.lit(60), F.lit(60), least=1).first().angle == -5.0


def test_gutter_of_a_spread(spark):
    """A wide page, against the same search written for one profile."""
    from folioloom.operators import pixels as kernels

    r = np.random.default_rng(6)
    w, h = 300, 30
    img = np.full((h, w), 240)
    img[:, 20:140] = np.where(r.random((h, 120)) < 0.3, 20, 240)
    img[:, 165:280] = np.where(r.random((h, 115)) < 0.3, 20, 240)
    img[:, 148:153] -= 60
    df = spark.createDataFrame([(1, x, y, int(img[y, x])) for y in range(h) for x in range(w)], "page_id long, x int, y int, g int")
    inner = img[3:27]
    ink, lum = (inner <= 100).mean(axis=0), inner.mean(axis=0)
    mean = lambda v, k: np.array([v[max(0, x - k) : x + k + 1].mean() for x in range(w)])
    near, dark = mean(ink, 3), np.clip((mean(lum, 20) - mean(lum, 3)) / 40, 0, 1)
    score = (1 - near / near[105:195].max() + dark) * (1 - np.abs(np.arange(w) / w - 0.5) / 0.15 * 0.3)
    got = kernels.gutter(df, 100).first()
    assert got.x == 105 + score[105:195].argmax() and abs(got.score - score[got.x]) < 1e-6 and abs(got.x - 150) < 6
