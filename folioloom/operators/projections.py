"""Flattening grids: the projection that fits a grid's border best, and the gate over the halves of an image.

A grid is its nodes (keys, i, j, gw, gh, u, v): node i, j of gw by gh stands at (i / (gw - 1), j / (gh - 1)) of the flat page
and comes from (u, v) of the photo. The eight numbers of a projection are least squares over the border's nodes: the normal
equations are sums, one row a grid, and are solved in array expressions, for all grids at once. Grids whose border determines
no projection stay as they are; so do grids of one row or column, which have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fits import solved


def _places() -> tuple[Column, Column]:
    return F.try_divide(F.col("i"), F.col("gw") - 1), F.try_divide(F.col("j"), F.col("gh") - 1)


def projections(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """keys and h, the projection's eight numbers, of each grid that has one: u = (h0 s + h1 t + h2) / (h6 s + h7 t + 1), v
    likewise from h3 to h5."""
    border = nodes.filter((F.col("gw") > 1) & (F.col("gh") > 1) & (F.col("i").isin(0) | F.col("j").isin(0) | (F.col("i") == F.col("gw") - 1) | (F.col("j") == F.col("gh") - 1)))
    s, t = _places()
    p = border.select(*keys, s.alias("s"), t.alias("t"), "u", "v")
    s, t, u, v = (F.col(c) for c in "stuv")
    one = F.lit(1.0)
    rows = ([s, t, one, None, None, None, -u * s, -u * t], u), ([None, None, None, s, t, one, -v * s, -v * t], v)

    def total(a: int, b: int | None) -> Column:
        """The sum of the products of two columns of both equations, or of one with the right side."""
        parts = [r[a] * (right if b is None else r[b]) for r, right in rows if r[a] is not None and (b is None or r[b] is not None)]
        return F.coalesce(F.sum(sum(parts[1:], parts[0])), F.lit(0.0)) if parts else F.lit(0.0)

    names = {(a, b): f"__{a}_{b}" for a in range(8) for b in range(a, 8)} | {(a, None): f"__{a}" for a in range(8)}
    sums = p.groupBy(*keys).agg(*[total(a, b).alias(n) for (a, b), n in names.items()])
    system = F.array(*[F.array(*[F.col(names[min(a, b), max(a, b)]) for b in range(8)], F.col(names[a, None])) for a in range(8)])
    return sums.select(*keys, solved(system, F.lit(8)).alias("h")).filter("h is not null")


def without_bends(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """nodes with the u and v of their grid's projection: the page's outline and perspective stay, bends inside go."""
    s, t = _places()
    h = F.col("h")
    d = h[6] * s + h[7] * t + 1.0
    u, v = (F.try_divide(h[k] * s + h[k + 1] * t + h[k + 2], d) for k in (0, 3))
    out = nodes.join(projections(nodes, keys), keys, "left")
    return out.withColumns({"u": F.coalesce(u, "u"), "v": F.coalesce(v, "v")}).select(nodes.columns)


def gated(first: DataFrame, second: DataFrame, keys: list[str], applied: Column, parts: int = 2) -> DataFrame:
    """The rows of second (a second pass over the parts of an image) where an image has so many and the pass took hold on each
    of them; else the rows of first. A part on which it is unknown whether it took hold counts as one on which it did not."""
    whole = second.groupBy(*keys).agg(F.bool_and(F.coalesce(applied, F.lit(False))).alias("all"), F.count("*").alias("n")).filter(F.col("all") & (F.col("n") == parts)).select(*keys)
    return second.join(whole, keys, "left_semi").unionByName(first.join(whole, keys, "left_anti"), allowMissingColumns=True)
