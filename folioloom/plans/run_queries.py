"""Queries over ink as runs, skew, fits and displacement, with SQL for the same tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import displacement as D
from ..operators import fits
from ..operators import projections as P
from ..operators import runs as R
from ..operators import skew as K
from .queries import COMPONENTS, PX, pages, query, table


def ink(spark, sf_dir, level: int):
    return pages(spark, sf_dir).filter(F.col("g") <= level)


RUNS = f"""WITH {PX}, i AS (SELECT page_id, x, y, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS k FROM px WHERE g <= 100)"""


@query(f"{RUNS} SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM i GROUP BY page_id, y, k")
def ink_runs(spark, sf_dir):
    return R.runs(ink(spark, sf_dir, 100))


@query(f"""WITH {PX}, d AS (SELECT page_id, x, y, max((g <= 100)::INT) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS d FROM px),
c AS (SELECT page_id, x, y, min(d) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS c FROM d)
SELECT page_id, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY page_id, y ORDER BY x) AS k FROM c WHERE c = 1) GROUP BY page_id, y, k""")
def closed_runs(spark, sf_dir):
    px = pages(spark, sf_dir)
    return R.closed(R.runs(px.filter("g <= 100")), px.select("page_id").distinct().withColumn("w", F.lit(8)), 4)


@query(COMPONENTS + """, k AS (SELECT * FROM c WHERE height >= 2 AND area >= 4 AND height <= 6 AND width <= 6 AND width <= height * 12 AND height <= width * 12),
s AS (SELECT page_id, height, row_number() OVER (PARTITION BY page_id ORDER BY height) AS r, count(*) OVER (PARTITION BY page_id) AS n FROM k WHERE height >= 3)
SELECT page_id, count(*) AS n_kept, (SELECT count(*) FROM s WHERE s.page_id = k.page_id) AS n, coalesce((SELECT max(height) FROM s WHERE s.page_id = k.page_id AND r = floor(s.n * 0.65) + 1), 0)::INT AS height FROM k GROUP BY page_id""")
def character_heights(spark, sf_dir):
    parts = R.components(R.runs(ink(spark, sf_dir, 90)))
    chars = R.characters(parts, F.lit(8), F.lit(8))
    return R.character_heights(chars).join(chars.groupBy("page_id").agg(F.count("*").alias("n_kept")), "page_id").select("page_id", "n_kept", "n", "height")


@query(COMPONENTS + """, k AS (SELECT * FROM c WHERE area >= 3 AND "left" >= 1 AND top >= 1 AND "left" + width <= 7 AND top + height <= 7
  AND NOT (("left" + width < 0 OR "left" > 7) AND height > width * 15))
SELECT page_id, floor(min("left") * 2.5)::BIGINT AS x, floor(min(top) * 2.5)::BIGINT AS y, (least(ceil(max("left" + width) * 2.5), 20) - floor(min("left") * 2.5))::BIGINT AS w,
  (least(ceil(max(top + height) * 2.5), 20) - floor(min(top) * 2.5))::BIGINT AS h FROM k GROUP BY page_id""")
def content_of_runs(spark, sf_dir):
    """Pages of 20 x 20 pixels, analysed at 8 x 8."""
    parts = R.content(R.components(R.runs(ink(spark, sf_dir, 90))), F.lit(8), F.lit(8))
    return R.content_box(parts, F.lit(0.4), F.lit(20), F.lit(20))


@query(COMPONENTS + """, t AS (SELECT m.page_id, l.label::BIGINT AS label, x, y FROM m JOIN l ON m.page_id = l.page_id AND m.id = l.id)
SELECT page_id, label, x, round(avg(y), 9) AS y FROM t GROUP BY page_id, label, x""")
def component_centroids(spark, sf_dir):
    rows, _ = R.labelled(R.runs(ink(spark, sf_dir, 90)))
    return R.centroids(rows).withColumn("y", F.round("y", 9))


@query(f"""WITH {PX}, d AS (SELECT page_id, x, y, max((g <= 100)::INT) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS d FROM px),
c AS (SELECT page_id, x, y, min(d) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS c FROM d)
SELECT page_id, x, min(y) AS top, max(y) AS bottom FROM c WHERE c = 1 GROUP BY page_id, x""")
def text_outlines(spark, sf_dir):
    return R.outlines(closed_runs(spark, sf_dir))


def _skew_sql(least: int) -> str:
    """Every ink pixel at every angle: coarse angles first, then those around the best of them."""
    score = lambda name, angles: f"""{name} AS (SELECT page_id, axis, deg, sum(n * n) AS score FROM (SELECT page_id, axis, deg, floor(CASE WHEN axis = 'h' THEN y * cos(radians(deg)) - x * sin(radians(deg)) ELSE x * cos(radians(deg)) + y * sin(radians(deg)) END + 6.5) AS bin, count(*) AS n
  FROM pts JOIN ({angles}) a USING (page_id, axis) GROUP BY ALL) GROUP BY ALL)"""  # noqa: E731
    best = lambda name, of: f"{name} AS (SELECT * FROM {of} QUALIFY row_number() OVER (PARTITION BY page_id, axis ORDER BY score DESC, deg) = 1)"
    every = "SELECT page_id, axis, deg FROM (SELECT DISTINCT page_id, axis FROM pts), (SELECT -5 + unnest(range(41)) * 0.25::DOUBLE AS deg)"
    around = "SELECT page_id, axis, deg - 0.25 + k * 0.02::DOUBLE AS deg FROM c, (SELECT unnest(range(26)) AS k)"
    return f"""WITH {PX}, p AS (SELECT page_id, x - 4.0::DOUBLE AS x, y - 4.0::DOUBLE AS y FROM px WHERE g <= 100),
pts AS (SELECT p.*, axis FROM p, (SELECT unnest(['h', 'v']) AS axis) WHERE page_id IN (SELECT page_id FROM p GROUP BY page_id HAVING count(*) >= {least})),
{score("coarse", every)}, {best("c", "coarse")}, {score("fine", around)}, {best("f", "fine")},
m AS (SELECT page_id, axis, greatest(avg(score), 1) AS mean FROM coarse GROUP BY page_id, axis),
b AS (SELECT c.page_id, c.axis, CASE WHEN f.score > c.score THEN f.deg ELSE c.deg END AS deg, greatest(f.score, c.score) / m.mean AS sharp FROM c JOIN f USING (page_id, axis) JOIN m USING (page_id, axis)),
o AS (SELECT h.page_id, h.deg AS h, v.deg AS v, h.sharp AS hs, v.sharp AS vs FROM b h JOIN b v ON h.page_id = v.page_id AND h.axis = 'h' AND v.axis = 'v')
SELECT n.page_id, n.n, round(CASE WHEN vs > hs * 1.1 THEN v ELSE h END, 9) AS angle, round(hs, 9) AS across, round(vs, 9) AS down FROM (SELECT page_id, count(*) AS n FROM p GROUP BY page_id) n LEFT JOIN o USING (page_id)"""


@query(_skew_sql(12))
def skew_search(spark, sf_dir):
    out = K.skew(ink(spark, sf_dir, 100), F.lit(8), F.lit(8), least=12)
    return out.select("page_id", "n", *[F.round(c, 9).alias(c) for c in ("angle", "across", "down")])


#: lineitem as points along curves: one curve a supplier.
POINTS = "SELECT l_suppkey AS k, ((l_orderkey * 7 + l_linenumber) % 997)::DOUBLE AS x, l_extendedprice / 1000 + ((l_orderkey * 7 + l_linenumber) % 997) / 50.0::DOUBLE AS y FROM lineitem"
HALF, OUTLIER = 500.0, 25.0


def points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    place = ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 997).cast("double")
    return li.select(F.col("l_suppkey").alias("k"), place.alias("x"), (F.col("l_extendedprice") / 1000 + place / 50.0).alias("y"), F.lit(HALF).alias("half"), F.lit(2).alias("degree"), F.lit(OUTLIER).alias("outlier"))


def _fits_sql(turns: int = 10, flat: int = 6) -> str:
    """Every turn spelled out: parabolas by determinants, medians by rank, points dropped; then the turns of the flat line."""
    det = lambda a, b, c: f"({a[0]} * ({b[1]} * {c[2]} - {c[1]} * {b[2]}) - {b[0]} * ({a[1]} * {c[2]} - {c[1]} * {a[2]}) + {c[0]} * ({a[1]} * {b[2]} - {b[1]} * {a[2]}))"
    s0, s1, s2, t = ("s0", "s1", "s2"), ("s1", "s2", "s3"), ("s2", "s3", "s4"), ("t0", "t1", "t2")
    coefficients = ", ".join(f"{det(*cols)} / {det(s0, s1, s2)} AS c{i}" for i, cols in enumerate(((t, s1, s2), (s0, t, s2), (s0, s1, t))))
    sums = ", ".join([f"sum({'*'.join(['u'] * i) or '1.0'}) AS s{i}" for i in range(5)] + [f"sum({'*'.join(['u'] * i + ['y'])}) AS t{i}" for i in range(3)])
    parts = [f"p0 AS (SELECT *, (x - {HALF}) / {HALF} AS u, count(*) OVER (PARTITION BY k) AS n0 FROM ({POINTS}))"]
    for i in range(turns):
        end = "true" if i == turns - 1 else f"max(off) OVER (PARTITION BY k) <= lim AND lim <= {OUTLIER}"
        parts += [
            f"c{i} AS (SELECT k, {coefficients} FROM (SELECT k, count(*) AS n, {sums} FROM p{i} GROUP BY k) WHERE n >= 7)",
            f"o{i} AS (SELECT p.*, c0, c1, c2, abs(c0 + u * c1 + u * u * c2 - y) AS off FROM p{i} p JOIN c{i} USING (k))",
            f"m{i} AS (SELECT k, greatest({OUTLIER}, 2 * max(off)) AS lim FROM (SELECT k, off, row_number() OVER (PARTITION BY k ORDER BY off) AS r, count(*) OVER (PARTITION BY k) AS n FROM o{i}) WHERE r <= n // 2 + 1 GROUP BY k)",
            f"e{i} AS (SELECT o.*, lim, {end} AS fin FROM o{i} o JOIN m{i} USING (k))",
            f"p{i + 1} AS (SELECT k, x, y, u, n0 FROM e{i} WHERE NOT fin AND off <= lim)",
        ]
    parts.append("f AS (" + " UNION ALL ".join(f"SELECT k, x, y, u, n0, c0, c1, c2, off FROM e{i} WHERE fin" for i in range(turns)) + ")")
    parts.append("g AS (SELECT k, any_value(c0) AS c0, any_value(c1) AS c1, any_value(c2) AS c2, min(x) AS x0, max(x) AS x1, count(*) AS n, sqrt(avg(off * off)) AS rms FROM f GROUP BY k HAVING count(*) >= 0.5 * any_value(n0))")
    parts.append("q AS (SELECT k, x, row_number() OVER (PARTITION BY k ORDER BY x, y) - 1 AS i, u FROM f)")
    parts.append("w0 AS (SELECT q.k, x, c0 + u * c1 + u * u * c2 AS y, true AS say FROM q JOIN g USING (k) WHERE q.i % greatest(g.n // 200, 1) = 0)")
    for i in range(flat):
        parts += [
            f"l{i} AS (SELECT *, (n * sxy - sx * sy) / (n * sxx - sx * sx) AS b FROM (SELECT k, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(x * y) AS sxy FROM w{i} WHERE say GROUP BY k) WHERE n >= 2)",
            f"d{i} AS (SELECT w.*, (sy - b * sx) / n AS a, b, abs(y - (sy - b * sx) / n - b * w.x) AS off FROM w{i} w JOIN l{i} USING (k))",
            f"n{i} AS (SELECT k, greatest(1.5 * max(off), 0.5) AS lim FROM (SELECT k, off, row_number() OVER (PARTITION BY k ORDER BY off) AS r, count(*) OVER (PARTITION BY k) AS n FROM d{i}) WHERE r <= n // 2 + 1 GROUP BY k)",
            f"h{i} AS (SELECT d.*, {'true' if i == flat - 1 else 'avg((off <= lim)::INT) OVER (PARTITION BY k) < 0.3'} AS fin, off <= lim AS next FROM d{i} d JOIN n{i} USING (k))",
            f"w{i + 1} AS (SELECT k, x, y, next AS say FROM h{i} WHERE NOT fin)",
        ]
    lines = " UNION ALL ".join(f"SELECT k, a, b FROM h{i} WHERE fin" for i in range(flat))
    return f"""WITH {", ".join(parts)}
SELECT g.k, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, x0, x1, n, round(rms, 6) AS rms, round(a, 6) AS a, round(b, 8) AS b FROM g JOIN (SELECT DISTINCT k, a, b FROM ({lines})) USING (k)"""


@query(_fits_sql())
def robust_fits(spark, sf_dir):
    c = fits.curves(points(spark, sf_dir), ["k"], 1e9)
    return c.select("k", *[F.round(F.col("poly")[i], 6).alias(f"c{i}") for i in range(3)], "x0", "x1", "n", *[F.round(v, d).alias(v) for v, d in (("rms", 6), ("a", 6), ("b", 8))])


#: orders as curves of pages: a page a customer, parabolas with ends anywhere, displaced by numbers without a short form.
CURVES = """SELECT o_custkey AS page_id, o_orderkey AS k, 100.0::DOUBLE AS half, (o_orderkey * 37 % 150)::DOUBLE AS x0, (o_orderkey * 37 % 150)::DOUBLE + 10 + o_orderkey * 13 % 45 AS x1,
  20.0::DOUBLE + o_orderkey * 11 % 100 AS p0, (o_orderkey % 9 - 4) * 1.937::DOUBLE AS p1, (o_orderkey % 5) * 2.719::DOUBLE AS p2, 17.8634792178::DOUBLE + o_orderkey * 11 % 100 AS a, (o_orderkey % 3) / 97.0::DOUBLE AS b FROM orders"""


def some_curves(spark, sf_dir):
    k = F.col("o_orderkey")
    low = (k * 37 % 150).cast("double")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("page_id"), k.alias("k"), F.lit(100.0).alias("half"), low.alias("x0"), (low + 10 + k * 13 % 45).alias("x1"),
        F.array(20.0 + k * 11 % 100, (k % 9 - 4) * 1.937, (k % 5) * 2.719).alias("poly"), (17.8634792178 + k * 11 % 100).alias("a"), ((k % 3) / 97.0).alias("b"),
    )


def _grid_sql(tail: str) -> str:
    y = lambda x: f"(p0 + (({x}) - half) / half * p1 + (({x}) - half) / half * (({x}) - half) / half * p2)"
    bent = lambda x: f"({y(x)} - a - b * ({x}))"
    return f"""WITH c AS ({CURVES}), i AS (SELECT page_id, unnest(range(26)) AS i FROM (SELECT DISTINCT page_id FROM c)),
f AS (SELECT i.i, i.i * 8.0::DOUBLE AS x, c.*, greatest(x0 - i.i * 8, i.i * 8 - x1, 0) AS far, greatest((x1 - x0) * 0.03, 2.0) AS e FROM i JOIN c USING (page_id)),
u AS (SELECT * FROM f QUALIFY far <= 16 OR (min(far) OVER (PARTITION BY page_id, i) > 16 AND far <= min(far) OVER (PARTITION BY page_id, i) + 10)),
n AS (SELECT page_id, i, a + b * x AS t, avg(least(greatest(CASE WHEN x < x0 THEN {bent("x0")} + ({bent("x0 + e")} - {bent("x0")}) / e * (x - x0)
   WHEN x > x1 THEN {bent("x1")} + ({bent("x1")} - {bent("x1 - e")}) / e * (x - x1) ELSE {bent("x")} END, -9.6::DOUBLE), 9.6::DOUBLE)) AS d FROM u GROUP BY 1, 2, 3),
g AS (SELECT page_id, i, j, j * 8.0::DOUBLE AS t FROM (SELECT DISTINCT page_id, i FROM n), (SELECT unnest(range(16)) AS j)),
v AS (SELECT g.*, n.t AS t0, n.d AS d0 FROM g ASOF LEFT JOIN n ON g.page_id = n.page_id AND g.i = n.i AND g.t >= n.t),
z AS (SELECT v.*, n.t AS t1, n.d AS d1 FROM v ASOF LEFT JOIN n ON v.page_id = n.page_id AND v.i = n.i AND v.t <= n.t),
o AS (SELECT page_id, i, j, CASE WHEN t0 IS NULL THEN d1 WHEN t1 IS NULL THEN d0 WHEN t1 - t0 < 1e-6 THEN d0 + (d1 - d0) * 0.5 ELSE d0 + (d1 - d0) * ((t - t0) / (t1 - t0)) END AS d FROM z)
{tail}"""


def sizes(spark, sf_dir):
    return some_curves(spark, sf_dir).select("page_id").distinct().select("page_id", F.lit(200).alias("w"), F.lit(120).alias("h"))


@query(_grid_sql("SELECT page_id, i, j, round(d, 4) + 0.0::DOUBLE AS d FROM o"))
def displacement_grid(spark, sf_dir):
    return D.grid(some_curves(spark, sf_dir), sizes(spark, sf_dir), 0.08).withColumn("d", F.round("d", 4) + F.lit(0.0))


_TEXT = """, r AS (SELECT page_id, least(greatest(floor(min(least(a + b * x0, a + b * x1)) / 8), 0), 15) AS j0, ceil(max(greatest(a + b * x0, a + b * x1)) / 8) AS j1 FROM c GROUP BY page_id),
y AS (SELECT o.page_id, i, avg(abs(d)) AS z FROM o JOIN r ON r.page_id = o.page_id AND j BETWEEN j0 AND least(greatest(j1, j0), 15) GROUP BY o.page_id, i)"""


@query(_grid_sql(_TEXT.lstrip("\n") + " SELECT page_id, i, round(z, 4) AS z FROM y"))
def depth_profile(spark, sf_dir):
    c, p = some_curves(spark, sf_dir), sizes(spark, sf_dir)
    return D.depths(D.grid(c, p, 0.08), c, p).withColumn("z", F.round("z", 4))


@query("""WITH k AS (SELECT user_id, event_id, sum(8 + abs(value)) OVER w AS s, (row_number() OVER w - 1) * 8.0::DOUBLE AS p FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
q AS (SELECT o_custkey AS user_id, o_orderkey, o_totalprice / 10 AS s FROM orders WHERE o_custkey IN (SELECT user_id FROM k)),
a AS (SELECT q.*, k.s AS s0, k.p AS p0 FROM q ASOF LEFT JOIN k ON q.user_id = k.user_id AND q.s >= k.s), b AS (SELECT a.*, k.s AS s1, k.p AS p1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.s <= k.s)
SELECT user_id, o_orderkey, round(CASE WHEN s0 IS NULL THEN s WHEN s1 IS NULL THEN p0 + (s - s0) WHEN s1 > s0 THEN p0 + (s - s0) / (s1 - s0) * (p1 - p0) ELSE p0 END, 6) AS p FROM b""")
def inverse_lengths(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("event_id")
    k = table(spark, sf_dir, "events").select("user_id", F.sum(8 + F.abs("value")).over(w).alias("s"), ((F.row_number().over(w) - 1) * 8.0).alias("p"))
    q = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey", (F.col("o_totalprice") / 10).alias("s"))
    q = q.join(k.select("user_id").distinct(), "user_id", "left_semi")
    return D.inverted(q, k, ["user_id"], "s", "p").select("user_id", "o_orderkey", F.round("p", 6).alias("p"))


def grids(spark, sf_dir):
    """Vectors as projections, seen on grids of 5 by 4 nodes whose inner nodes are bent."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    n = e.select("vec_id", "e", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("n")).select("vec_id", "e", (F.col("n") % 5).alias("i"), F.floor(F.col("n") / 5).cast("int").alias("j"))
    s, t, v = F.col("i") / 4, F.col("j") / 3, F.col("e")
    d = 1 + 0.2 * v[6] * s + 0.2 * v[7] * t
    inner = F.col("i").between(1, 3) & F.col("j").between(1, 2)
    u = ((1 + 0.2 * v[0]) * s + 0.2 * v[1] * t + v[2]) / d + F.when(inner, 0.05).otherwise(0.0)
    w = (0.2 * v[3] * s + (1 + 0.2 * v[4]) * t + v[5]) / d - F.when(inner, 0.03).otherwise(0.0)
    return n.select("vec_id", "i", "j", F.lit(5).alias("gw"), F.lit(4).alias("gh"), u.alias("u"), w.alias("v"))


@query("""WITH n AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(20)) AS n FROM embeddings), p AS (SELECT vec_id, (n % 5)::INT AS i, (n // 5)::INT AS j, (n % 5) / 4.0::DOUBLE AS s, (n // 5) / 3.0::DOUBLE AS t, e FROM n)
SELECT vec_id, i, j, round(((1 + 0.2 * e[1]) * s + 0.2 * e[2] * t + e[3]) / (1 + 0.2 * e[7] * s + 0.2 * e[8] * t), 7) + 0.0 AS u, round((0.2 * e[4] * s + (1 + 0.2 * e[5]) * t + e[6]) / (1 + 0.2 * e[7] * s + 0.2 * e[8] * t), 7) + 0.0 AS v FROM p""")
def flat_grids(spark, sf_dir):
    out = P.without_bends(grids(spark, sf_dir), ["vec_id"])
    return out.select("vec_id", "i", "j", *[(F.round(c, 7) + F.lit(0.0)).alias(c) for c in "uv"])


@query("""WITH w AS (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) = 4 AND bool_and(l_returnflag <> 'R'))
SELECT l_orderkey AS image, l_linenumber AS half, l_quantity AS x FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM w)
UNION ALL SELECT o_orderkey, -1, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM w)""")
def gate_of_halves(spark, sf_dir):
    """Orders as images, their lines as the parts of a second pass."""
    second = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("half"), F.col("l_quantity").alias("x"), "l_returnflag")
    first = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.col("o_totalprice").alias("x"))
    return P.gated(first, second, ["image"], F.col("l_returnflag") != "R", parts=4).select("image", F.coalesce("half", F.lit(-1)).alias("half"), "x")
