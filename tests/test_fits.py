"""Fits of many curves and the displacement between them, against NumPy curve by curve."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioloom.operators import displacement, fits

POINTS = "k long, x double, y double, half double, degree int, outlier double"


def test_ten_thousand_curves(spark):
    r = np.random.default_rng(1)
    x = np.arange(0, 800, 20.0)
    rows, want = [], {}
    for k in range(10_000):
        d = 4 if k % 2 else 2
        y = np.polynomial.polynomial.polyval((x - 400) / 400, r.normal(size=d + 1) * 20) + r.normal(size=len(x))
        want[k] = np.polynomial.polynomial.polyfit((x - 400) / 400, y, d)
        rows.append(pd.DataFrame({"k": k, "x": x, "y": y, "half": 400.0, "degree": d, "outlier": None}))
    df = spark.createDataFrame(pd.concat(rows), POINTS)
    got = {g.k: g.poly for g in fits.trimmed(df, ["k"]).groupBy("k").agg(F.first("poly").alias("poly")).collect()}
    assert len(got) == 10_000 and all(len(got[k]) == len(w) and np.abs(np.array(got[k]) - w).max() < 1e-9 for k, w in want.items())


def brute_trimmed(x, y, half, degree, outlier):
    for turn in range(10):
        if len(x) < degree + 5:
            return None
        c = np.polynomial.polynomial.polyfit((x - half) / half, y, degree)
        off = np.abs(np.polynomial.polynomial.polyval((x - half) / half, c) - y)
        limit = max(outlier, 2 * np.sort(off)[len(off) // 2])
        if turn == 9 or (limit <= outlier and (off <= limit).all()):
            return c, x, off
        x, y = x[off <= limit], y[off <= limit]


def test_points_far_from_their_curve_go(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for k in range(60):
        x = np.sort(r.choice(1000, 150, replace=False)).astype(float)
        y = 100 + 5 * ((x - 500) / 500) - 9 * ((x - 500) / 500) ** 2 + r.normal(size=150) * 0.4
        bad = r.random(150) < (0.2 if k % 3 else 0.7)
        y = np.where(bad, y + r.uniform(-80, 80, 150), y)
        rows += [(k, float(a), float(b), 500.0, 3, 3.0) for a, b in zip(x, y)]
        found = brute_trimmed(x, y, 500.0, 3, 3.0)
        if found and len(found[1]) >= 75 and np.sqrt(np.mean(found[2] ** 2)) <= 1.5:
            want[k] = found
    rows += [(100, float(i), 1.0, 2.0, 3, 3.0) for i in range(7)] + [(101, 5.0, float(i), 2.0, 2, None) for i in range(30)] + [(102, None, 1.0, 2.0, 2, None), (102, 1.0, None, 2.0, 2, None)]
    got = {c.k: c for c in fits.curves(spark.createDataFrame(rows, POINTS), ["k"], 1.5).collect()}
    assert got.keys() == want.keys() and 20 < len(want) < 60  # too few points and singular systems give no curve
    for k, (c, x, off) in want.items():
        assert np.allclose(got[k].poly, c, atol=1e-8) and (got[k].x0, got[k].x1, got[k].n) == (x[0], x[-1], len(x)) and abs(got[k].rms - np.sqrt(np.mean(off**2))) < 1e-9
    assert all(abs(got[k].poly[1] - 5) < 1.2 and abs(got[k].poly[2] + 9) < 1.5 for k in got if k % 3)


def test_the_flat_part_gives_the_line(spark):
    rows = []
    for k, slope in ((0, 0.0), (1, 0.02)):
        for x in np.arange(0, 1000, 2.0):
            rows.append((k, float(x), float(50 + slope * x - 40 * max(0.0, 1 - x / 250) ** 2), 500.0, 4, None))
    got = {c.k: c for c in fits.curves(spark.createDataFrame(rows, POINTS), ["k"], 5.0).collect()}
    for k, slope in ((0, 0.0), (1, 0.02)):
        assert abs(got[k].b - slope) < 0.012 and abs(got[k].a + 700 * got[k].b - 50 - slope * 700) < 2.5


def test_systems_are_solved_with_pivots(spark):
    systems = [[[0.0, 1.0, 2.0], [1.0, 0.0, 3.0]], [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]], [[1e-9, 1.0, 1.0], [1.0, 1.0, 2.0]]]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(systems)], "i int, s array<array<double>>")
    got = {r.i: r.c for r in df.select("i", fits.solved(F.col("s"), F.lit(2)).alias("c")).collect()}
    assert got[0] == [3.0, 2.0] and got[1] is None and np.allclose(got[2], np.linalg.solve([[1e-9, 1.0], [1.0, 1.0]], [1.0, 2.0]))


def test_one_turn_shuffles_the_points_once(spark):
    df = spark.createDataFrame([(k, float(x), float(x % 7), 10.0, 2, 1.0) for k in range(20) for x in range(20)], POINTS)
    seen = []
    real = fits.kept
    fits.kept = lambda d, name, *a: (seen.append((name, d._jdf.queryExecution().executedPlan().toString())), real(d, name, *a))[1]
    try:
        fits.trimmed(df, ["k"]).count()
    finally:
        fits.kept = real
    plan = next(p for n, p in seen if n == "fit-turn")
    # every exchange is the one of the points, which Spark runs once: nothing else is dealt anew
    exchanges = [re.sub(r"#\d+", "", line.split("Exchange", 1)[1].split(", [plan_id")[0]) for line in plan.splitlines() if "Exchange hashpartitioning" in line or "Exchange rangepartitioning" in line or "SinglePartition" in line]
    assert len(set(exchanges)) == 1 and "REPARTITION_BY_COL" in exchanges[0]


def curves_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, poly array<double>, half double, x0 double, x1 double, a double, b double")


def brute_grid(curves, w, h, share):
    most = h * share
    val = lambda c, x: np.polynomial.polynomial.polyval((x - c[1]) / c[1], c[0]) - c[4] - c[5] * x

    def disp(c, x):
        e = max((c[3] - c[2]) * 0.03, 2.0)
        v = val(c, x)
        if x < c[2]:
            v = val(c, c[2]) + (val(c, c[2] + e) - val(c, c[2])) / e * (x - c[2])
        if x > c[3]:
            v = val(c, c[3]) + (val(c, c[3]) - val(c, c[3] - e)) / e * (x - c[3])
        return min(max(v, -most), most)

    out = np.zeros((-(-h // 8) + 1, -(-w // 8) + 1))
    for i in range(out.shape[1]):
        x = i * 8.0
        far = np.array([max(c[2] - x, x - c[3], 0) for c in curves])
        use = np.flatnonzero(far <= 16) if (far <= 16).any() else np.flatnonzero(far <= far.min() + w * 0.05)
        knots = sorted((curves[k][4] + curves[k][5] * x, disp(curves[k], x)) for k in use)
        out[:, i] = np.interp(np.arange(out.shape[0]) * 8.0, *zip(*knots))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_grid_between_curves(spark, seed):
    r = np.random.default_rng(seed)
    pages = {}
    for p in range(6):
        n = int(r.integers(1, 9))
        x0 = r.uniform(0, 300, n)
        pages[p] = [(list(map(float, r.normal(size=3) * 6 + (60 + 30 * k, 0, 0))), 200.0, float(x0[k]), float(x0[k] + r.uniform(5, 99)), float(60 + 30 * k + r.normal()), float(r.normal() * 0.01)) for k in range(n)]
    df = curves_of(spark, [(p, *c) for p, cs in pages.items() for c in cs])
    size = spark.createDataFrame([(p, 400, 300) for p in range(7)], "page_id long, w int, h int")
    nodes = displacement.grid(df, size, 0.08)
    got = {p: np.full((39, 51), np.nan) for p in pages}
    rows = nodes.collect()
    for n in rows:
        got[n.page_id][n.j, n.i] = n.d
    assert len(rows) == 6 * 39 * 51  # the page without curves has none
    for p, cs in pages.items():
        assert np.allclose(got[p], brute_grid(cs, 400, 300, 0.08), atol=1e-9)
    z = {(d.page_id, d.i): d.z for d in displacement.depths(nodes, df, size, 2.0).collect()}
    for p, cs in pages.items():
        ends = [c[4] + c[5] * x for c in cs for x in c[2:4]]
        j0 = min(max(int(np.floor(min(ends) / 8)), 0), 38)
        j1 = min(max(int(np.ceil(max(ends) / 8)), j0), 38)
        assert np.allclose([z[p, i] for i in range(51)], 2 * np.abs(got[p][j0 : j1 + 1]).mean(axis=0))


def test_blur_and_inverse(spark):
    from folioloom.functions import rasters

    g = np.random.default_rng(3).normal(size=(12, 9))
    df = spark.createDataFrame([(1, i, j, float(g[j, i])) for j in range(12) for i in range(9)], "page_id long, i long, j long, d double")
    want = rasters.blur(g.astype(np.float32), 1.5)
    assert all(abs(n.d - want[n.j, n.i]) < 1e-5 for n in displacement.blurred(df).collect())
    s = np.array([0.0, 8.5, 17.0, 30.0])
    sums = spark.createDataFrame([(1, float(v), 8.0 * i) for i, v in enumerate(s)], "k long, s double, p double")
    probes = spark.createDataFrame([(1, v, "x") for v in (-3.0, 0.0, 4.0, 8.5, 20.0, 30.0, 41.0)] + [(2, 5.0, "x")], "k long, s double, t string")
    got = {(r.k, r.s): r.p for r in displacement.inverted(probes, sums, ["k"], "s", "p").collect()}
    for v in (0.0, 4.0, 8.5, 20.0, 30.0):
        assert abs(got[1, v] - np.interp(v, s, np.arange(4) * 8.0)) < 1e-9
    assert got[1, -3.0] == -3.0 and got[1, 41.0] == 24.0 + 11.0 and got[2, 5.0] == 5.0
