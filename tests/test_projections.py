"""Projections of grids against the page-by-page form, and the gate over halves."""

import numpy as np
from pyspark.sql import functions as F

from folioloom.functions import grids
from folioloom.operators import projections

SCHEMA = "k long, i int, j int, gw int, gh int, u double, v double"


def rows(k, g):
    _, gh, gw = g.shape
    return [(k, i, j, gw, gh, float(g[0, j, i]), float(g[1, j, i])) for j in range(gh) for i in range(gw)]


def test_projections_equal_those_of_single_grids(spark):
    r = np.random.default_rng(1)
    held = {}
    for k in range(30):
        t, s = np.mgrid[0:9, 0:7] / np.array([8, 6])[:, None, None]
        h = np.eye(3).ravel()[:8] + r.normal(size=8) * 0.1
        d = h[6] * s + h[7] * t + 1
        held[k] = np.stack([(h[0] * s + h[1] * t + h[2]) / d, (h[3] * s + h[4] * t + h[5]) / d]) + r.normal(size=(2, 9, 7)) * 0.01
    held[100] = np.zeros((2, 4, 4))  # a projection to a point: every photo place is the same
    held[101] = np.ones((2, 1, 5))  # one row
    df = spark.createDataFrame([x for k, g in held.items() for x in rows(k, g)], SCHEMA).repartition(4)
    out = {k: np.full(g.shape, np.nan) for k, g in held.items()}
    for n in projections.without_bends(df, ["k"]).collect():
        out[n.k][:, n.j, n.i] = n.u, n.v
    for k in range(30):
        assert np.abs(out[k] - grids.without_curl(held[k])).max() < 1e-6
    assert np.allclose(out[100], held[100]) and np.allclose(out[101], held[101])
    assert projections.projections(df.filter("k < 0"), ["k"]).count() == 0


def test_gate_needs_every_half(spark):
    first = spark.createDataFrame([(i, f"first{i}") for i in range(5)], "image int, page string")
    second = spark.createDataFrame([(0, 0, True, "a"), (0, 1, True, "b"), (1, 0, True, "c"), (1, 1, False, "d"), (2, 0, True, "e"), (3, 0, True, "f"), (3, 1, None, "g")], "image int, half int, ok boolean, page string")
    got = {(r.image, r.half, r.page) for r in projections.gated(first, second, ["image"], F.col("ok")).collect()}
    assert got == {(0, 0, "a"), (0, 1, "b"), *[(i, None, f"first{i}") for i in (1, 2, 3, 4)]}
