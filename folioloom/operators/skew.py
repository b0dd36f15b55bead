"""The angle of a page's lines: of all angles, the one whose projection of the ink is sharpest.

A score is the sum of squared counts of ink pixels by rotated coordinate. Runs, not pixels, are projected: along a run the
coordinate changes so slowly that it falls into few bins, and how many of its pixels fall into each is arithmetic. Runs
across give the projection of horizontal lines, runs down that of vertical ones. A coarse search over all angles and a fine
one around its best are two aggregates each, over all pages at once.

The first of equal scores wins: the smaller angle, and a coarse one before a fine one. A page with too little ink has no
angle. page_id may not be null; a pixel counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.work import kept
from . import runs

#: The border that is not looked at (hundredths), the least ink, the largest angle, the steps, how much sharper
#: lines down must be than lines across.
EDGE, LEAST, MOST, COARSE, FINE, DOWN = 3, 500, 5.0, 0.25, 0.02, 1.1


def inner(mask: DataFrame, w: Column, h: Column) -> DataFrame:
    """The ink within the border, with the page's size: page_id, x, y, w, h."""
    rows = mask.select("page_id", "x", "y", w.cast("int").alias("w"), h.cast("int").alias("h"))
    bx, by = (F.floor(F.col(c) * EDGE / 100) for c in "wh")
    return rows.filter((F.col("x") >= bx) & (F.col("x") < F.col("w") - bx) & (F.col("y") >= by) & (F.col("y") < F.col("h") - by))


def lines_of(ink: DataFrame) -> DataFrame:
    """Runs across (axis h) and down (axis v) of inner(): page_id, axis, at (their row or column), t0 and t1 from the middle
    of the page, and size, the number of bins."""
    size = ink.groupBy("page_id").agg(F.first("w").alias("w"), F.first("h").alias("h"))
    size = size.withColumn("size", F.floor(F.sqrt(F.col("w").cast("double") * F.col("w") + F.col("h") * F.col("h"))) + 2)
    across = runs.runs(ink).withColumn("axis", F.lit("h"))
    down = runs.runs(ink.select("page_id", F.col("y").alias("x"), F.col("x").alias("y"))).withColumn("axis", F.lit("v"))
    rows = across.unionByName(down).join(size, "page_id")
    mid = lambda across, down: F.when(F.col("axis") == "h", F.col(across)).otherwise(F.col(down)) / 2
    return rows.select("page_id", "axis", "size", (F.col("y") - mid("h", "w")).alias("at"), (F.col("x0") - mid("w", "h")).alias("t0"), (F.col("x1") - mid("w", "h")).alias("t1"))


def scores(rows: DataFrame) -> DataFrame:
    """page_id, axis, deg and score of lines_of() rows with an angle deg."""
    c, s = F.cos(F.radians("deg")), F.sin(F.radians("deg")) * F.when(F.col("axis") == "h", -1).otherwise(1)
    r = rows.withColumn("base", F.col("at") * c + F.col("size") / 2).withColumn("s", s)
    b0, b1 = (F.floor(F.col("base") + F.col(t) * F.col("s")) for t in ("t0", "t1"))
    r = r.withColumn("bin", F.explode(F.sequence(F.least(b0, b1), F.greatest(b0, b1))))
    # the places t0, t0 + 1, ... of a run between those where the coordinate enters and leaves the bin
    upto = lambda edge: F.floor((edge - F.col("base")) / F.col("s") - F.col("t0"))
    before = lambda edge: F.ceil((edge - F.col("base")) / F.col("s") - F.col("t0"))
    last = (F.col("t1") - F.col("t0")).cast("long")
    first = F.when(F.col("s") > 0, before(F.col("bin"))).when(F.col("s") < 0, upto(F.col("bin") + 1) + 1).otherwise(0)
    end = F.when(F.col("s") > 0, before(F.col("bin") + 1) - 1).when(F.col("s") < 0, upto(F.col("bin"))).otherwise(last)
    r = r.withColumn("n", F.least(end, last) - F.greatest(first, F.lit(0)) + 1)
    bins = r.filter("n > 0 and bin >= 0 and bin < size").repartition("page_id", "axis", "deg").groupBy("page_id", "axis", "deg", "bin").agg(F.sum("n").alias("n"))
    return bins.groupBy("page_id", "axis", "deg").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def _best(of: DataFrame) -> list[Column]:
    """The highest score and its angle, the smallest of several."""
    top = F.max(F.struct("score", (-F.col("deg")).alias("less")))
    return [top["score"].alias("score"), (-top["less"]).alias("deg")]


def skew(mask: DataFrame, w: Column, h: Column, least: int = LEAST, most: float = MOST) -> DataFrame:
    """page_id, n (pixels of ink), angle (null where they are too few), and how sharp lines across and down are. w, h: the
    page's size, columns of mask (page_id, x, y) or literals."""
    ink = inner(mask, w, h).distinct()
    counts = kept(ink.groupBy("page_id").agg(F.count("*").alias("n")), "skew-counts")
    rows = kept(lines_of(ink.join(counts.filter(F.col("n") >= least), "page_id", "left_semi")), "skew-lines")
    steps = int(round(2 * most / COARSE))
    angle = F.explode(F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: k * COARSE - most))
    coarse = kept(scores(rows.withColumn("deg", angle)).groupBy("page_id", "axis").agg(*_best(rows), F.greatest(F.avg("score"), F.lit(1.0)).alias("mean")), "skew-coarse")
    around = F.explode(F.transform(F.sequence(F.lit(0), F.lit(int(round(2 * COARSE / FINE)))), lambda k: F.col("center") - COARSE + k * FINE))
    near = rows.join(coarse.select("page_id", "axis", F.col("deg").alias("center")), ["page_id", "axis"]).withColumn("deg", around).drop("center")
    fine = scores(near).groupBy("page_id", "axis").agg(*_best(near)).select("page_id", "axis", F.col("score").alias("fine"), F.col("deg").alias("fine_deg"))
    both = coarse.join(fine, ["page_id", "axis"])
    both = both.select("page_id", "axis", F.when(F.col("fine") > F.col("score"), F.col("fine_deg")).otherwise(F.col("deg")).alias("deg"), (F.greatest("fine", "score") / F.col("mean")).alias("sharp"))
    pick = lambda axis, c: F.max(F.when(F.col("axis") == axis, F.col(c)))
    found = both.groupBy("page_id").agg(pick("h", "deg").alias("h"), pick("v", "deg").alias("v"), pick("h", "sharp").alias("across"), pick("v", "sharp").alias("down"))
    angle = F.when(F.col("down") > F.col("across") * DOWN, F.col("v")).otherwise(F.col("h"))
    return counts.join(found, "page_id", "left").select("page_id", "n", angle.alias("angle"), "across", "down")
