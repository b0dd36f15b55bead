"""Queries over the given tables, one a kernel, with their SQL. Vectors of 64 values are read as 8 x 8 grey pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import books as B
from ..operators import pixels as P

QUERIES: dict = {}
SQL: dict[str, str] = {}

PX = """px AS (SELECT vec_id AS page_id, (i % 8)::INT AS x, (i // 8)::INT AS y,
  least(greatest(round((embedding[i + 1]::DOUBLE + 0.5) * 255), 0), 255)::INT AS g
  FROM (SELECT vec_id, embedding, unnest(range(64)) AS i FROM embeddings))"""
OPTIONS = {"rotate": 0, "unwarp": True, "split": True, "dewarp": True}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.grey_pages(table(spark, sf_dir, "embeddings"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as content boxes: a book a supplier, a page a line; every seventh page has no box."""
    li = table(spark, sf_dir, "lineitem")
    box = lambda c: F.when(F.col("l_orderkey") % 7 != 0, c)
    pages_ = li.select(
        F.col("l_suppkey").alias("book_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("page_idx"), F.lit(2480).alias("pw"), F.lit(3508).alias("ph"),
        box(F.floor(F.col("l_discount") * 3000)).alias("x"), box(F.floor(F.col("l_tax") * 9000)).alias("y"),
        box(F.floor(F.col("l_quantity") * 40)).alias("w"), box(F.floor(F.col("l_extendedprice") / 40)).alias("h"),
    )
    return pages_


BOXES = """b AS (SELECT l_suppkey AS book_id, l_orderkey * 8 + l_linenumber AS page_idx, 2480 AS pw, 3508 AS ph,
  CASE WHEN l_orderkey % 7 <> 0 THEN floor(l_discount * 3000)::BIGINT END AS x, CASE WHEN l_orderkey % 7 <> 0 THEN floor(l_tax * 9000)::BIGINT END AS y,
  CASE WHEN l_orderkey % 7 <> 0 THEN floor(l_quantity * 40)::BIGINT END AS w, CASE WHEN l_orderkey % 7 <> 0 THEN floor(l_extendedprice / 40)::BIGINT END AS h
  FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY w NULLS LAST) AS rw, row_number() OVER (PARTITION BY book_id ORDER BY h NULLS LAST) AS rh,
  count(w) OVER (PARTITION BY book_id) AS n FROM b),
l AS (SELECT book_id, max(w) AS cw, max(h) AS ch, max(CASE WHEN rw = round((n - 1) * 0.5) + 1 THEN w END) AS median_w,
  max(CASE WHEN rh = round((n - 1) * 0.5) + 1 THEN h END) AS median_h, round(least(max(w), max(h)) * 0.05)::BIGINT AS margin FROM s GROUP BY book_id),
o AS (SELECT *, coalesce(cw + 2 * margin, 2480)::BIGINT AS out_w, coalesce(ch + 2 * margin, 3508)::BIGINT AS out_h FROM l)"""


@query(f"""WITH {BOXES} SELECT b.book_id, page_idx, out_w, out_h,
  CASE WHEN median_w IS NULL THEN 0 WHEN w IS NULL THEN trunc((pw - out_w) / 2.0) WHEN w >= 0.8 * median_w THEN x - margin
       ELSE x + w // 2 - out_w // 2 END::BIGINT AS ox,
  CASE WHEN median_w IS NULL THEN 0 WHEN w IS NULL THEN trunc((ph - out_h) / 2.0) WHEN h >= 0.8 * median_h OR y + h / 2.0 < 0.4 * ph THEN y - margin
       ELSE y + h // 2 - out_h // 2 END::BIGINT AS oy FROM b JOIN o USING (book_id)""")
def plan_crops(spark, sf_dir):
    return B.plan_crops(boxes(spark, sf_dir))


@query(f"WITH {BOXES} SELECT book_id, out_w, out_h, margin, median_w, median_h FROM o")
def book_layout(spark, sf_dir):
    return B.layout(boxes(spark, sf_dir))


@query("""WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL), k AS (SELECT source, coalesce(list_aggregate(list_transform(
  regexp_extract_all(upper(source), '([0-9]+|[^0-9]+)'), lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN
  '0' || lpad(length(regexp_replace(r, '^0+', ''))::VARCHAR, 5, '0') || regexp_replace(r, '^0+', '') ELSE r END), 'string_agg', ''), '') AS key FROM s)
SELECT source, row_number() OVER (ORDER BY key, source)::INT AS place FROM k""")
def natural_order(spark, sf_dir):
    # distinct names only: as many rows as there are sources
    s = table(spark, sf_dir, "documents").select("source").filter("source is not null").distinct()
    return s.select("source", F.row_number().over(Window.orderBy(S.natural_key(F.col("source")), "source")).alias("place"))


@query("""WITH o AS (SELECT doc_id, toxic = 1 AND quality = 0 AS skip, CASE WHEN quality = 0 THEN 90 END AS rotate, CASE WHEN toxic = 1 THEN false END AS unwarp,
  CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN 'at' END AS split_mode, (doc_id % 5) * 0.4 AS split_at, CASE WHEN doc_id % 4 = 0 THEN true END AS dewarp FROM labels)
SELECT d.doc_id, coalesce(rotate, 0)::INT AS rotate, coalesce(unwarp, true) AS unwarp, CASE WHEN split_mode = 'none' THEN 'none' WHEN split_mode = 'at' THEN 'at' ELSE 'auto' END AS split,
  CASE WHEN split_mode = 'at' THEN round(least(greatest(split_at, 0.0), 1.0), 6)::DOUBLE END AS split_at, coalesce(dewarp, NOT coalesce(unwarp, true)) AS dewarp
FROM (SELECT doc_id FROM documents) d LEFT JOIN o USING (doc_id) WHERE NOT coalesce(skip, false)""")
def override_resolution(spark, sf_dir):
    o = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("toxic") == 1) & (F.col("quality") == 0)).alias("skip"), F.when(F.col("quality") == 0, 90).alias("rotate"), F.when(F.col("toxic") == 1, False).alias("unwarp"),
        F.when(F.col("doc_id") % 3 == 0, "none").when(F.col("doc_id") % 3 == 1, "at").alias("split_mode"), ((F.col("doc_id") % 5) * 0.4).alias("split_at"),
        F.when(F.col("doc_id") % 4 == 0, True).alias("dewarp"),
    )
    out = B.resolve(table(spark, sf_dir, "documents").select("doc_id"), o, ["doc_id"], OPTIONS)
    return out.withColumn("split_at", F.round("split_at", 6))


@query("""SELECT o_custkey, o_orderkey, page_idx FROM (SELECT o_custkey, o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1)::INT AS page_idx
  FROM orders WHERE o_orderstatus <> 'F') WHERE page_idx < 3""")
def first_pages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'").select("o_custkey", "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("file"))
    return B.page_order(o, "o_custkey", "file", limit=3).drop("file")


@query(f"WITH {PX} SELECT page_id, x, round(avg((g <= 100)::INT), 9) AS ink, round(avg(g), 9) AS lum FROM px GROUP BY page_id, x")
def column_profile(spark, sf_dir):
    return P.column_profile(pages(spark, sf_dir), 100).select("page_id", "x", F.round("ink", 9).alias("ink"), F.round("lum", 9).alias("lum"))


@query(f"""WITH {PX}, p AS (SELECT page_id, x, avg((g <= 100)::INT) AS ink, avg(g) AS lum FROM px GROUP BY page_id, x),
q AS (SELECT *, avg(ink) OVER w AS near_ink, avg(lum) OVER w AS near FROM p WINDOW w AS (PARTITION BY page_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r AS (SELECT page_id, x, round((1 - near_ink / greatest(max(near_ink) OVER (PARTITION BY page_id), 1e-9) + least(greatest((lum - near) / 40, 0), 1)) * (1 - abs(x / 8.0 - 0.5) / 0.15 * 0.3), 9) AS score FROM q WHERE x >= 2 AND x < 5)
SELECT page_id, x, score FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, x) = 1""")
def gutter_search(spark, sf_dir):
    return P.gutter(pages(spark, sf_dir), 100)


@query(f"""WITH {PX}, r AS (SELECT *, max(g) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM px)
SELECT page_id, x, y, max(m) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM r""")
def max_filter(spark, sf_dir):
    return P.max_filter(pages(spark, sf_dir), 2).select("page_id", "x", "y", "m")


@query(f"""WITH {PX} SELECT a.page_id, a.x, a.y, ((a.g + 10) * count(*) <= sum(b.g)) AS ink FROM px a JOIN px b ON a.page_id = b.page_id AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 GROUP BY a.page_id, a.x, a.y, a.g""")
def adaptive_threshold(spark, sf_dir):
    return P.adaptive_ink(pages(spark, sf_dir), 5, 10).select("page_id", "x", "y", "ink")


@query(f"""WITH {PX}, d AS (SELECT page_id, x, y, max((g <= 100)::INT) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS d FROM px)
SELECT page_id, x, y, min(d) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING) AS closed FROM d""")
def close_horizontal(spark, sf_dir):
    return P.close_horizontal(pages(spark, sf_dir).withColumn("on", (F.col("g") <= 100).cast("int")), 4).select("page_id", "x", "y", "closed")


@query(f"""WITH {PX}, h AS (SELECT page_id, g, count(*) AS n FROM px GROUP BY page_id, g),
c AS (SELECT page_id, g, sum(n) OVER u AS w0, sum(n * g) OVER u AS s0, sum(n) OVER (PARTITION BY page_id) AS w, sum(n * g) OVER (PARTITION BY page_id) AS s FROM h WINDOW u AS (PARTITION BY page_id ORDER BY g)),
v AS (SELECT page_id, g, CASE WHEN w > w0 THEN round((s0 * (w - w0) - (s - s0) * w0)::DOUBLE * (s0 * (w - w0) - (s - s0) * w0) / (w0 * (w - w0)), 6) ELSE 0 END AS v FROM c)
SELECT page_id, g AS level FROM v QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY v DESC, g) = 1""")
def otsu_level(spark, sf_dir):
    return P.otsu(pages(spark, sf_dir))


@query(f"""WITH {PX}, b AS (SELECT page_id, slope, floor((y * 8 - x * slope) / 8.0) AS bin, count(*) AS n FROM px, (SELECT unnest([-2, -1, 0, 1, 2]) AS slope) WHERE g <= 100 GROUP BY 1, 2, 3)
SELECT page_id, slope, sum(n * n)::BIGINT AS score FROM b GROUP BY page_id, slope""")
def projection_scores(spark, sf_dir):
    return P.projection_scores(pages(spark, sf_dir), 100, [-2, -1, 0, 1, 2])


@query(f"""WITH {PX}, p AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x) - 1 AS pos, abs(g - 128) AS b FROM px)
SELECT page_id, avg((greatest(g, 128, b) - least(g, 128, b) > 40)::INT) < 0.002 AS grey FROM p WHERE pos % 7 = 0 GROUP BY page_id""")
def grey_test(spark, sf_dir):
    px = pages(spark, sf_dir).withColumn("c", F.lit(128)).withColumn("b", F.abs(F.col("g") - 128))
    return P.is_grey(px, "g", "c", "b")


@query(f"WITH {PX} SELECT page_id, 7 - y AS x, x AS y, g FROM px")
def rotate_page(spark, sf_dir):
    return P.rotate(pages(spark, sf_dir), 90)


@query(f"WITH {PX} SELECT page_id, CASE WHEN page_id % 9 BETWEEN 1 AND 7 THEN (x >= page_id % 9)::INT END AS half, (CASE WHEN page_id % 9 BETWEEN 1 AND 7 AND x >= page_id % 9 THEN x - page_id % 9 ELSE x END)::BIGINT AS x, y, g FROM px")
def split_page(spark, sf_dir):
    return P.split_at(pages(spark, sf_dir), F.col("page_id") % 9)


@query(f"""WITH {PX}, t AS (SELECT DISTINCT page_id FROM embeddings, (SELECT vec_id AS page_id FROM embeddings)) SELECT p.page_id, tx.x, ty.y, coalesce(px.g, 255)::INT AS g
FROM (SELECT DISTINCT page_id FROM px) p, (SELECT unnest(range(10))::INT AS x) tx, (SELECT unnest(range(6))::INT AS y) ty LEFT JOIN px ON px.page_id = p.page_id AND px.x = tx.x - 3 AND px.y = ty.y + 4""".replace(", t AS (SELECT DISTINCT page_id FROM embeddings, (SELECT vec_id AS page_id FROM embeddings))", ""))
def crop_with_padding(spark, sf_dir):
    return P.crop(pages(spark, sf_dir), -3, 4, 10, 6)


@query(f"WITH {PX} SELECT page_id, x, y, CASE WHEN x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 6 THEN g ELSE 255 END AS g FROM px")
def fill_outside(spark, sf_dir):
    return P.fill_outside(pages(spark, sf_dir), 2, 3, 6, 6, 1)


@query(f"WITH {PX}, m AS (SELECT *, max(g) OVER (PARTITION BY page_id) AS bg FROM px) SELECT page_id, x, y, least(greatest(round(g * 255.0::DOUBLE / greatest(bg, 16) * 255.0::DOUBLE / 235), 0), 255)::INT AS g FROM m")
def divide_background(spark, sf_dir):
    px = pages(spark, sf_dir).withColumn("bg", F.max("g").over(P.page()))
    return px.select("page_id", "x", "y", P.divide_background(F.col("g"), F.col("bg")).alias("g"))


COMPONENTS = f"""WITH RECURSIVE {PX}, m AS (SELECT page_id, x, y, y * 65536 + x AS id FROM px WHERE g <= 90),
r(page_id, id, label) AS (SELECT page_id, id, id FROM m UNION SELECT b.page_id, b.id, r.label FROM r JOIN m a ON a.page_id = r.page_id AND a.id = r.id
  JOIN m b ON b.page_id = a.page_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
l AS (SELECT page_id, id, min(label) AS label FROM r GROUP BY page_id, id),
c AS (SELECT m.page_id, label::BIGINT AS label, min(x) AS "left", min(y) AS top, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM m JOIN l ON m.page_id = l.page_id AND m.id = l.id GROUP BY m.page_id, label)"""


@query(COMPONENTS + " SELECT * FROM c")
def page_components(spark, sf_dir):
    return P.components(pages(spark, sf_dir).filter("g <= 90"))


@query(COMPONENTS + """ SELECT page_id, min("left") AS x, min(top) AS y, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM c WHERE area >= 3 GROUP BY page_id""")
def content_boxes(spark, sf_dir):
    return P.content_box(P.components(pages(spark, sf_dir).filter("g <= 90")).filter("area >= 3"))


@query("""SELECT l_suppkey, count(*) AS n, round(sum(u), 6) AS su, round(sum(u * u), 6) AS suu, round(sum(p), 4) AS sy, round(sum(u * p), 4) AS suy, round(regr_slope(p, u) FILTER (WHERE l_quantity >= 10), 4) AS slope
FROM (SELECT l_suppkey, l_quantity, l_quantity / 25.0 - 1 AS u, l_extendedprice / 1000.0 AS p FROM lineitem) GROUP BY l_suppkey""")
def curve_sums(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity", (F.col("l_quantity") / 25 - 1).alias("u"), (F.col("l_extendedprice") / 1000).alias("p"))
    r = lambda c, n: F.round(c, n)
    return li.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), r(F.sum("u"), 6).alias("su"), r(F.sum(F.col("u") * F.col("u")), 6).alias("suu"), r(F.sum("p"), 4).alias("sy"),
        r(F.sum(F.col("u") * F.col("p")), 4).alias("suy"), r(F.expr("regr_slope(p, u) FILTER (WHERE l_quantity >= 10)"), 4).alias("slope"),
    )


@query("""SELECT l_partkey, l_quantity::INT AS x, round(avg(l_extendedprice), 4) AS y, round(min(l_extendedprice), 2) AS top, round(max(l_extendedprice), 2) AS bottom FROM lineitem GROUP BY l_partkey, l_quantity""")
def line_centroids(spark, sf_dir):
    y = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey", F.col("l_quantity").cast("int").alias("x")).agg(F.round(F.avg(y), 4).alias("y"), F.round(F.min(y), 2).alias("top"), F.round(F.max(y), 2).alias("bottom"))


@query("""WITH s AS (SELECT l_partkey, l_quantity, row_number() OVER (PARTITION BY l_partkey ORDER BY l_quantity) AS r, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem)
SELECT l_partkey, max(CASE WHEN r = round((n - 1) * 0.75) + 1 THEN l_quantity END) AS q75, max(CASE WHEN r = floor(n * 0.65) + 1 THEN l_quantity END) AS h65, max(CASE WHEN r = n // 2 + 1 THEN l_quantity END) AS middle FROM s GROUP BY l_partkey""")
def ranked_quantiles(spark, sf_dir):
    q = F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(S.quantile(q, 0.75).alias("q75"), S.at_share(q, 0.65).alias("h65"), S.at_share(q, 0.5).alias("middle"))


@query("""WITH k AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, avg(value) AS v FROM events GROUP BY user_id, epoch_us(ts)),
p AS (SELECT o_custkey AS user_id, o_orderkey, 1704067200.0::DOUBLE + o_orderkey * 61.5 AS t FROM orders WHERE o_custkey IN (SELECT user_id FROM k)),
a AS (SELECT p.*, k.t AS t0, k.v AS v0 FROM p ASOF LEFT JOIN k ON p.user_id = k.user_id AND p.t >= k.t), b AS (SELECT a.*, k.t AS t1, k.v AS v1 FROM a ASOF LEFT JOIN k ON a.user_id = k.user_id AND a.t <= k.t)
SELECT user_id, o_orderkey, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL THEN v0 WHEN t1 - t0 < 1e-6 THEN v0 + (v1 - v0) * 0.5 ELSE v0 + (v1 - v0) * ((t - t0) / (t1 - t0)) END, 6) AS v FROM b""")
def asof_interpolation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    knots = e.groupBy("user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t")).agg(F.avg("value").alias("v"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), (F.lit(1704067200.0) + F.col("o_orderkey") * 61.5).alias("t"), "o_orderkey")
    o = o.join(e.select("user_id").distinct(), "user_id", "left_semi")
    return B.asof_line(o, knots, "user_id", "t", "v").select("user_id", "o_orderkey", F.round("v", 6).alias("v"))


@query("""WITH d AS (SELECT user_id, event_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS dz FROM events)
SELECT user_id, event_id, round(sum(coalesce(sqrt(64 + dz * dz), 0)) OVER (PARTITION BY user_id ORDER BY event_id), 6) AS s FROM d""")
def arc_lengths(spark, sf_dir):
    return B.arc_length(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 8.0).select("user_id", "event_id", F.round("s", 6).alias("s"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def skip_existing(spark, sf_dir):
    done = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(done, "c_custkey", "left_anti")


@query("""SELECT p_partkey, p_brand, p_brand || CASE WHEN n > 1 THEN ' (' || n || ')' ELSE '' END || '.pdf' AS output FROM (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY lower(p_brand) ORDER BY p_partkey) AS n FROM part)""")
def unique_outputs(spark, sf_dir):
    return B.output_names(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", ["p_partkey"])


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1")
def first_occurrence(spark, sf_dir):
    return B.first_of_each(table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), "l_partkey", ["l_orderkey", "l_linenumber"])


@query("SELECT o_orderstatus, count(*) AS books, count_if(o_totalprice > 100000)::BIGINT AS failed, max(o_orderkey) + 1 AS next FROM orders GROUP BY o_orderstatus")
def batch_status(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("books"), F.count_if(F.col("o_totalprice") > 100000).alias("failed"), (F.max("o_orderkey") + 1).alias("next"))


@query("""SELECT page_id, replace(url_encode(url), '~', '%7E') AS encoded, format('{:05d}.png', page_id) AS file, regexp_replace(url, '[/\\\\][^/\\\\]*$', '') AS parent FROM pages""")
def page_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", S.percent_encoded(F.col("url")).alias("encoded"), F.format_string("%05d.png", "page_id").alias("file"), S.parent(F.col("url")).alias("parent"))
