"""Ink as runs: a page is the runs of its rows (page_id, y, x0, x1, both ends within), a few thousand rows instead of millions
of pixels. Runs come from gaps and islands; runs of neighbouring rows meet in an interval join on cells of CELL columns, so
that a row of many runs compares each with a few; components are the labels that hooking and pointer jumping leave, for all
pages at once, in a number of rounds that grows with the logarithm of the number of runs.

A run's id is y * 2**16 + x0, which is its component's label where it is the least: pages are narrower than 65,536 pixels.
Empty masks give no rows; equal pixels count once; pages are told apart by page_id, which may not be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_share
from ..sources.work import kept

CELL = 64
#: What a character may be (parts of the page's height and width, and the least of these), the largest ratio of
#: its sides; the border that content keeps clear of, the outer parts in which tall strokes are shadows, and how tall.
CHAR_H, CHAR_W, CHAR_LEAST, CHAR_SIDES, CHAR_SHARE = 15, 8, 6, 12, 0.65
BORDER, OUTER, TALL = 0.015, 12, 15


def runs(mask: DataFrame) -> DataFrame:
    """Runs of ink pixels (page_id, x, y)."""
    p = mask.select("page_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    island = F.col("x") - F.row_number().over(Window.partitionBy("page_id", "y").orderBy("x"))
    return p.withColumn("__i", island).groupBy("page_id", "y", "__i").agg(F.min("x").alias("x0"), F.max("x").alias("x1")).drop("__i")


def run_id() -> Column:
    return F.col("y").cast("long") * 65536 + F.col("x0")


def pixels(rows: DataFrame) -> DataFrame:
    """The pixels of runs, with what else they have."""
    return rows.withColumn("x", F.explode(F.sequence("x0", "x1"))).drop("x0", "x1")


def closed(rows: DataFrame, widths: DataFrame, width: int) -> DataFrame:
    """Closing across by a segment of this width: a gap shorter than it is filled, and so is one at an edge that the half of
    the segment reaches. widths: page_id and w of the pages."""
    half = width // 2
    row = Window.partitionBy("page_id", "y").orderBy("x0")
    r = rows.join(widths.select("page_id", "w"), "page_id").withColumn("__before", F.lag("x1").over(row)).withColumn("__last", F.lead("x0").over(row).isNull())
    left = F.when(F.col("__before").isNull() & (F.col("x0") <= width - 1 - half), 0).otherwise(F.col("x0"))
    right = F.when(F.col("__last") & (F.col("w") - 1 - F.col("x1") <= half), F.col("w") - 1).otherwise(F.col("x1"))
    starts = F.coalesce(F.col("x0") - F.col("__before") - 1 >= width, F.lit(True))
    r = r.withColumn("__n", F.sum(starts.cast("int")).over(row))
    return r.select("page_id", "y", "__n", left.cast("int").alias("x0"), right.cast("int").alias("x1")).groupBy("page_id", "y", "__n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("__n")


def touching(rows: DataFrame) -> DataFrame:
    """page_id, a and b: ids of runs of neighbouring rows that touch, corners included. a is the upper one."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / CELL), F.floor(high / CELL)))
    upper = rows.select("page_id", F.col("y").alias("row"), F.col("x0").alias("u0"), F.col("x1").alias("u1"), run_id().alias("a"), cells(F.col("x0") - 1, F.col("x1") + 1).alias("cell"))
    lower = rows.select("page_id", (F.col("y") - 1).alias("row"), "x0", "x1", run_id().alias("b"), cells(F.col("x0"), F.col("x1")).alias("cell"))
    both = upper.join(lower, ["page_id", "row", "cell"]).filter((F.col("x0") <= F.col("u1") + 1) & (F.col("x1") >= F.col("u0") - 1))
    return both.select("page_id", "a", "b").distinct()


def labelled(rows: DataFrame) -> tuple[DataFrame, int]:
    """Runs with label, the least id of their component, and the number of rounds it took. A round looks at the grandparents
    of a run's neighbours; the run, its parent and its own grandparent take the least of them."""
    rows = kept(rows.withColumn("id", run_id()), "runs")
    edges = touching(rows)
    edges = kept(edges.unionByName(edges.select("page_id", F.col("b").alias("a"), F.col("a").alias("b"))), "run-edges")
    state, rounds = rows.select("page_id", "id", F.col("id").alias("f")), 0
    while True:
        rounds += 1
        up = state.select("page_id", F.col("id").alias("f"), F.col("f").alias("g"))
        s = kept(state.join(up, ["page_id", "f"]).select("page_id", "id", "f", "g"), "run-parents")
        least = edges.join(s.select("page_id", F.col("id").alias("b"), "g"), ["page_id", "b"]).groupBy("page_id", F.col("a").alias("id")).agg(F.min("g").alias("m"))
        s = s.join(least, ["page_id", "id"], "left")
        hooks = s.groupBy("page_id", F.col("f").alias("id")).agg(F.min("m").alias("h"))
        new = s.join(hooks, ["page_id", "id"], "left").select("page_id", "id", F.least("f", "g", "m", "h").alias("f"), (F.least("f", "g", "m", "h") != F.col("f")).alias("moved"))
        new = kept(new, "run-labels")
        state = new.select("page_id", "id", "f")
        if not new.filter("moved").take(1):
            return rows.join(state.withColumnRenamed("f", "label"), ["page_id", "id"]).drop("id"), rounds


def components(rows: DataFrame) -> DataFrame:
    """page_id, label, left, top, width, height and area of the 8-connected components of runs."""
    return stats(labelled(rows)[0])


def stats(labels: DataFrame) -> DataFrame:
    left, top = F.min("x0"), F.min("y")
    return labels.groupBy("page_id", "label").agg(
        left.alias("left"), top.alias("top"), (F.max("x1") - left + 1).alias("width"), (F.max("y") - top + 1).alias("height"), F.sum(F.col("x1") - F.col("x0") + 1).alias("area")
    )


def characters(parts: DataFrame, w: Column, h: Column) -> DataFrame:
    """The components that may be characters of a page w wide and h high."""
    cw, ch = F.col("width"), F.col("height")
    most_h, most_w = F.greatest(F.floor(h / CHAR_H), F.lit(CHAR_LEAST)), F.greatest(F.floor(w / CHAR_W), F.lit(CHAR_LEAST))
    return parts.filter((ch >= 2) & (F.col("area") >= 4) & (ch <= most_h) & (cw <= most_w) & (cw <= ch * CHAR_SIDES) & (ch <= cw * CHAR_SIDES))


def character_heights(chars: DataFrame) -> DataFrame:
    """page_id, n and height: the number of characters three pixels high or more, and their upper middle height (0 for none)."""
    high = F.when(F.col("height") >= 3, F.col("height"))
    return chars.groupBy("page_id").agg(F.count(high).alias("n"), F.coalesce(at_share(high, CHAR_SHARE), F.lit(0)).alias("height"))


def content(parts: DataFrame, w: Column, h: Column) -> DataFrame:
    """The components that are content: no specks, nothing at the border, no tall strokes near the sides."""
    bx, by = F.ceil(w * BORDER), F.ceil(h * BORDER)
    left, top, right, low = F.col("left"), F.col("top"), F.col("left") + F.col("width"), F.col("top") + F.col("height")
    clear = (left >= bx) & (top >= by) & (right <= w - bx) & (low <= h - by)
    side = (right < F.floor(w * OUTER / 100)) | (left > F.floor(w * (100 - OUTER) / 100))
    return parts.filter((F.col("area") >= 3) & clear & ~(side & (F.col("height") > F.col("width") * TALL)))


def content_box(parts: DataFrame, scale: Column, full_w: Column, full_h: Column) -> DataFrame:
    """page_id and the box around components (x, y, w, h), in pixels of the full page of which the analysed one is scale times
    the size. The three are the same for all rows of a page."""
    x0, y0 = F.min(F.floor(F.col("left") / scale)), F.min(F.floor(F.col("top") / scale))
    x1, y1 = F.max(F.least(F.ceil((F.col("left") + F.col("width")) / scale), full_w)), F.max(F.least(F.ceil((F.col("top") + F.col("height")) / scale), full_h))
    return parts.groupBy("page_id").agg(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def centroids(labels: DataFrame) -> DataFrame:
    """page_id, label, x and y: the mean row of each component in each of its columns."""
    return pixels(labels).groupBy("page_id", "label", "x").agg(F.avg("y").alias("y"))


def outlines(rows: DataFrame) -> DataFrame:
    """page_id, x, top and bottom: the first and the last row of ink in each column."""
    return pixels(rows).groupBy("page_id", "x").agg(F.min("y").alias("top"), F.max("y").alias("bottom"))
