"""How far the text of a page is displaced, between its curves: nodes of a grid, CELL pixels apart.

Curves reach the columns that they cover in an interval join (each is expanded over its own columns). A column that no curve
covers takes the curves whose ends are nearest: the nearest end on either side comes from a sorted union, and all within a
tolerance from a join on stretches as long as the tolerance, of which a column meets two. Down each column the displacement
is interpolated between its curves. No page's curves meet all its columns.

A page without curves has no nodes. Two curves at the same place of a column count as one, by their mean.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import polynomial
from .books import asof_line

#: The grid's step; how far beyond its ends a curve still covers (pixels), how much further than the nearest a
#: curve may be (share of the width), the part of a curve that gives the slope at its ends, and its least length.
CELL, BEYOND, FURTHER, END, END_LEAST = 8, 16, 0.05, 0.03, 2.0


def target(x: Column) -> Column:
    return F.col("a") + F.col("b") * x


def bend(x: Column) -> Column:
    return polynomial(F.col("poly"), (x - F.col("half")) / F.col("half")) - target(x)


def displaced(x: Column, most: Column) -> Column:
    """A curve's bend at x, carried on straight beyond its ends."""
    edge = F.greatest((F.col("x1") - F.col("x0")) * END, F.lit(END_LEAST))
    low, high = bend(F.col("x0")), bend(F.col("x1"))
    before = low + (bend(F.col("x0") + edge) - low) / edge * (x - F.col("x0"))
    behind = high + (high - bend(F.col("x1") - edge)) / edge * (x - F.col("x1"))
    v = F.when(x < F.col("x0"), before).when(x > F.col("x1"), behind).otherwise(bend(x))
    return F.least(F.greatest(v, -most), most)


def columns(curves: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, i and the curve's columns, for each column of the grid and each curve that counts there. pages: page_id, w
    and h, once a page."""
    own = [c for c in curves.columns if c != "page_id"]
    c = curves.join(pages.select("page_id", "w"), "page_id").withColumn("last", F.ceil(F.col("w") / CELL))
    low, high = F.greatest(F.ceil((F.col("x0") - BEYOND) / CELL), F.lit(0)), F.least(F.floor((F.col("x1") + BEYOND) / CELL), F.col("last"))
    covered = c.filter(low <= high).withColumn("i", F.explode(F.sequence(low, high))).select("page_id", "i", *own)
    every = pages.join(curves.select("page_id").distinct(), "page_id").select("page_id", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("w") / CELL))).alias("i"))
    bare = every.join(covered.select("page_id", "i").distinct(), ["page_id", "i"], "left_anti").withColumn("x", (F.col("i") * CELL).cast("double"))
    # the nearest end on either side, of which bare columns have none that covers them
    ends = c.select("page_id", "w", F.lit(None).cast("long").alias("i"), F.explode(F.array(F.struct(F.col("x1").alias("x"), F.lit(True).alias("left")), F.struct(F.col("x0").alias("x"), F.lit(False).alias("left")))).alias("e"))
    ends = ends.select("page_id", "w", "i", F.col("e.x").cast("double").alias("x"), "e.left")
    both = bare.select("page_id", "w", "i", "x", F.lit(None).cast("boolean").alias("left")).unionByName(ends)
    up = Window.partitionBy("page_id").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("page_id").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    gaps = both.withColumn("l", F.last(F.when(F.col("left"), F.col("x")), ignorenulls=True).over(up)).withColumn("r", F.last(F.when(~F.col("left"), F.col("x")), ignorenulls=True).over(down))
    gaps = gaps.filter("i is not null").withColumn("far", F.least(F.col("x") - F.col("l"), F.col("r") - F.col("x")))
    step = F.col("w") * FURTHER
    # ends between far and far + step away, on either side, lie in two stretches of step pixels
    near = gaps.withColumn("left", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("from", F.when(F.col("left"), F.col("x") - F.col("far") - step).otherwise(F.col("x") + F.col("far")))
    near = near.select("page_id", "i", "left", "x", "far", F.explode(F.sequence(F.floor(F.col("from") / step), F.floor(F.col("from") / step) + 1)).alias("stretch"))
    sides = c.withColumn("left", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("stretch", F.floor(F.when(F.col("left"), F.col("x1")).otherwise(F.col("x0")) / step))
    met = near.select("page_id", "i", "left", "stretch", F.col("x").alias("at"), "far").join(sides, ["page_id", "left", "stretch"])
    away = F.when(F.col("left"), F.col("at") - F.col("x1")).otherwise(F.col("x0") - F.col("at"))
    met = met.filter((away >= 0) & (away <= F.col("far") + F.col("w") * FURTHER)).select("page_id", "i", *own).distinct()
    return covered.unionByName(met)


def grid(curves: DataFrame, pages: DataFrame, share: float) -> DataFrame:
    """page_id, i, j and d of every node of the grids of pages with curves (page_id, poly, half, x0, x1, a, b). share: the
    largest displacement, of the page's height."""
    at = (F.col("i") * CELL).cast("double")
    knots = columns(curves, pages).join(pages.select("page_id", "h"), "page_id").select("page_id", "i", target(at).alias("y"), displaced(at, F.col("h") * share).alias("d"))
    knots = knots.groupBy("page_id", "i", "y").agg(F.avg("d").alias("d"))
    rows = knots.select("page_id", "i").distinct().join(pages.select("page_id", "h"), "page_id")
    nodes = rows.select("page_id", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("h") / CELL))).alias("j")).withColumn("y", (F.col("j") * CELL).cast("double"))
    return asof_line(nodes, knots, ["page_id", "i"], "y", "d").select("page_id", "i", "j", "d")


def blurred(nodes: DataFrame, sigma: float = 1.5) -> DataFrame:
    """The grid smoothed both ways; beyond its edges it goes on as at them."""
    reach = math.ceil(sigma * 3)
    taps = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]

    def along(rows: DataFrame, order: str, other: str) -> DataFrame:
        w = Window.partitionBy("page_id", other).orderBy(order)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        rows = rows.withColumn("__a", F.first("d").over(whole)).withColumn("__z", F.last("d").over(whole))
        shifted = lambda k: F.col("d") if k == 0 else F.coalesce(F.lag("d", -k).over(w), F.col("__a")) if k < 0 else F.coalesce(F.lead("d", k).over(w), F.col("__z"))
        total = sum((shifted(k) * t for k, t in zip(range(-reach, reach + 1), taps)), F.lit(0.0))
        return rows.withColumn("d", total / sum(taps)).drop("__a", "__z")

    return along(along(nodes, "i", "j"), "j", "i")


def depths(nodes: DataFrame, curves: DataFrame, pages: DataFrame, strength: float = 1.0) -> DataFrame:
    """page_id, i and z: the mean displacement of each column within the rows of text."""
    ends = F.array(target(F.col("x0")), target(F.col("x1")))
    text = curves.groupBy("page_id").agg(F.min(F.array_min(ends)).alias("top"), F.max(F.array_max(ends)).alias("low")).join(pages.select("page_id", "h"), "page_id")
    last = F.ceil(F.col("h") / CELL)
    j0 = F.least(F.greatest(F.floor(F.col("top") / CELL), F.lit(0)), last)
    text = text.select("page_id", j0.alias("j0"), F.least(F.greatest(F.ceil(F.col("low") / CELL), j0), last).alias("j1"))
    return nodes.join(text, "page_id").filter(F.col("j").between(F.col("j0"), F.col("j1"))).groupBy("page_id", "i").agg((F.avg(F.abs("d")) * strength).alias("z"))


def inverted(probes: DataFrame, sums: DataFrame, keys: list[str], value: str, place: str) -> DataFrame:
    """probes (keys, value, ...) with place: where the growing sums (keys, place, value) reach their value. Linear between
    two knots; before the first the value itself, behind the last one on for one. One sorted union, no join."""
    other = [c for c in probes.columns if c not in (*keys, value)]
    both = probes.select(*keys, value, F.lit(True).alias("__probe"), F.lit(None).cast("double").alias("__p"), *other).unionByName(
        sums.select(*keys, F.col(value), F.lit(False).alias("__probe"), F.col(place).cast("double").alias("__p")), allowMissingColumns=True
    )
    knot = F.when(~F.col("__probe"), F.struct(F.col(value).cast("double").alias("s"), F.col("__p").alias("p")))
    up = Window.partitionBy(*keys).orderBy(value, "__probe").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc(value), "__probe").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__a", F.last(knot, ignorenulls=True).over(up)).withColumn("__b", F.last(knot, ignorenulls=True).over(down)).filter("__probe")
    v, a, b = F.col(value), F.col("__a"), F.col("__b")
    gap = b["s"] - a["s"]
    inside = a["p"] + F.when(gap > 0, (v - a["s"]) / gap * (b["p"] - a["p"])).otherwise(0.0)
    at = F.when(a.isNull(), v).when(b.isNull(), a["p"] + (v - a["s"])).otherwise(inside)
    return both.select(*keys, value, *other, at.alias(place))

