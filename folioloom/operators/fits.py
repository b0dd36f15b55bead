"""Fits of many curves at once: moments are aggregates, the small linear systems are solved in array expressions, and points
far from their curve go in turns, for all curves that still move.

A turn shuffles the points once, by curve: sums, medians and what is joined back to the points stay where the points are. A
curve leaves the loop as soon as a turn moves nothing. No curve's points stand in one Python object, but the residuals of one
curve are sorted in one aggregate, so a curve may have some millions of points.

Curves with too few points, with a singular system or with too large a residual give no row; so does a curve whose flat part
can't hold a line. Equal points count as often as they stand. Points with a null place or height are left out.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import at_share, polynomial
from ..sources.work import kept

#: Turns of trimming, points beyond the degree, the share of points that must stay, the pivot that counts as
#: zero; for the flat part: points looked at, turns, spread of the residuals, least limit, least share, least determinant.
TURNS, SPARE, STAY, PIVOT = 10, 5, 0.5, 1e-12
SOME, FLAT_TURNS, SPREAD, NEAR, LEAST, DET = 200, 6, 1.5, 0.5, 0.3, 1e-9
#: The largest degree of a curve.
MOST = 4


def solved(system: Column, size: Column) -> Column:
    """The solution of a linear system (rows of size + 1 numbers, the right side last), by elimination with the largest
    pivots; null if one is almost zero."""

    def step(m: Column, c: Column) -> Column:
        best = F.array_max(F.transform(F.sequence(c, size - 1), lambda r: F.struct(F.abs(m[r][c]).alias("v"), r.alias("r"))))
        turned = F.transform(m, lambda row, i: F.when(i == c, m[best["r"]]).when(i == best["r"], m[c]).otherwise(row))
        clear = lambda t: F.transform(t, lambda row, i: F.when(i == c, row).otherwise(F.zip_with(row, t[c], lambda a, b: a - row[c] / t[c][c] * b)))
        # the exchanged rows are named once, as the only element that is transformed
        return F.when(best["v"] >= PIVOT, F.transform(F.array(turned), clear)[0])

    done = F.aggregate(F.sequence(F.lit(0), size - 1), system, step)
    return F.transform(done, lambda row, i: row[size] / row[i])


def power_sums(u: Column, y: Column, most: int = MOST) -> list[Column]:
    """Aggregates: sums, of the powers of u up to twice the degree; and moments, of those up to the degree times y."""
    power = lambda k: reduce(lambda a, b: a * b, [u] * k, F.lit(1.0))
    return [F.array(*[F.sum(power(k)) for k in range(2 * most + 1)]).alias("sums"), F.array(*[F.sum(power(k) * y) for k in range(most + 1)]).alias("moments")]


def least_squares(sums: Column, moments: Column, degree: Column) -> Column:
    """The coefficients, ascending, of the polynomial of this degree."""
    places = F.sequence(F.lit(0), degree)
    rows = F.transform(places, lambda i: F.concat(F.transform(places, lambda j: sums[i + j]), F.array(moments[i])))
    return solved(rows, degree + 1)


def trimmed(points: DataFrame, keys: list[str], turns: int = TURNS) -> DataFrame:
    """points (keys, x, y, half, degree, outlier) that stay, with n0 (how many there were), poly and off, their distance from
    the curve. Where outlier is null a curve is fitted once; else points further off than outlier, and than twice the median
    distance, go in turns."""
    all_ = Window.partitionBy(*keys)
    rows = points.filter(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("u", (F.col("x") - F.col("half")) / F.col("half"))
    rows = kept(rows.select(*keys, "x", "y", "u", "half", "degree", "outlier", F.count("*").over(all_).alias("n0")), "fit-points")
    out = []
    for turn in range(turns):
        p = rows.repartition(*keys)
        curve = p.groupBy(*keys).agg(F.count("*").alias("__n"), F.first("degree").alias("__d"), *power_sums(F.col("u"), F.col("y")))
        curve = curve.filter(F.col("__n") >= F.col("__d") + SPARE).select(*keys, least_squares(F.col("sums"), F.col("moments"), F.col("__d")).alias("poly")).filter("poly is not null")
        near = p.join(curve, keys).withColumn("off", F.abs(polynomial(F.col("poly"), F.col("u")) - F.col("y")))
        spread = near.groupBy(*keys).agg(F.greatest(F.first("outlier"), 2 * at_share(F.col("off"), 0.5)).alias("limit"), F.max("off").alias("most"))
        # a curve is settled where the limit is the final one and all points keep it
        last = F.col("outlier").isNull() | F.lit(turn == turns - 1) | ((F.col("most") <= F.col("limit")) & (F.col("limit") <= F.col("outlier")))
        near = kept(near.join(spread, keys).withColumn("settled", F.coalesce(last, F.lit(True))).filter("settled or off <= limit").drop("limit", "most"), "fit-turn")
        out.append(near.filter("settled").drop("settled"))
        rows = near.filter("not settled").drop("settled", "poly", "off")
        if not rows.take(1):
            break
    return reduce(DataFrame.unionByName, out)


def flat_lines(samples: DataFrame, keys: list[str], turns: int = FLAT_TURNS) -> DataFrame:
    """keys, a and b of the line through the flat part of each curve: of samples (keys, x, y), those far from the line have no
    say in the next turn, and may have it again later. A curve's line stands when too few are left, or when a turn changes
    no sample's say."""
    rows, out = samples.select(*keys, "x", "y", F.lit(True).alias("say")), []
    for turn in range(turns):
        p = (kept(rows, "flat-turn") if turn else rows).repartition(*keys)
        x, y = (F.when(F.col("say"), F.col(c)) for c in "xy")
        sums = p.groupBy(*keys).agg(F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
        det = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        b = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / det
        line = sums.filter((F.col("n") >= 2) & (F.abs(det) >= DET)).select(*keys, b.alias("b"), ((F.col("sy") - b * F.col("sx")) / F.col("n")).alias("a"))
        near = p.join(line, keys).withColumn("off", F.abs(F.col("y") - F.col("a") - F.col("b") * F.col("x")))
        limit = near.groupBy(*keys).agg(F.greatest(SPREAD * at_share(F.col("off"), 0.5), F.lit(NEAR)).alias("limit"))
        near = near.join(limit, keys).withColumn("next", F.col("off") <= F.col("limit"))
        end = near.groupBy(*keys).agg((F.avg(F.col("next").cast("int")) < LEAST).alias("few"), F.bool_and(F.col("next") == F.col("say")).alias("same"))
        near = kept(near.join(end, keys).withColumn("done", F.col("few") | F.col("same") | F.lit(turn == turns - 1)), "flat-line")
        out.append(near.filter("done").groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b")))
        rows = near.filter("not done").select(*keys, "x", "y", F.col("next").alias("say"))
        if not rows.take(1):
            break
    return reduce(DataFrame.unionByName, out)


def curves(points: DataFrame, keys: Iterable[str], most_rms: Column | float) -> DataFrame:
    """keys, half, poly, x0, x1, n, rms, and a and b (the line along which the curve would run straight) of every curve that
    fits. points: keys, x, y, half (half the page's width; heights are polynomials of (x - half) / half), degree (MOST at
    most) and outlier (null: no trimming; else half of the points must stay). most_rms: the largest residual."""
    keys = list(keys)
    points = points.withColumn("__most", most_rms if isinstance(most_rms, Column) else F.lit(most_rms))
    most = points.groupBy(*keys).agg(F.first("__most").alias("most_rms"))
    stay = kept(trimmed(points, keys), "fit-stay")
    rms = F.sqrt(F.avg(F.col("off") * F.col("off")))
    found = stay.groupBy(*keys).agg(F.first("half").alias("half"), F.first("poly").alias("poly"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"), F.first("n0").alias("n0"), F.first("outlier").alias("outlier"), rms.alias("rms"))
    found = found.join(most, keys).filter((F.col("rms") <= F.col("most_rms")) & (F.col("outlier").isNull() | (F.col("n") >= STAY * F.col("n0")))).drop("most_rms", "n0", "outlier")
    found = kept(found, "fit-curves")
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("x", "y")) - 1
    some = stay.select(*keys, "x", "u", "y").withColumn("__i", turn).join(found.select(*keys, "poly", "n"), keys)
    some = some.filter(F.col("__i") % F.greatest(F.floor(F.col("n") / SOME), F.lit(1)) == 0).select(*keys, "x", polynomial(F.col("poly"), F.col("u")).alias("y"))
    return found.join(flat_lines(kept(some, "fit-samples"), keys), keys)
