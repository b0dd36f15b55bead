"""Queries that run the raster kernels inside Spark tasks, page by page, with SQL for the same pixels; and queries over
overrides, boxes and numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rasters as R
from ..operators import books as B
from ..sources import overrides
from .queries import COMPONENTS, PX, SQL, query, table


def each_page(spark, sf_dir: str, kernel: Callable, schema: str) -> DataFrame:
    """page_id and the rows of kernel(page): vectors of 64 values become 8 x 8 grey rasters in the task."""
    names = ["page_id", *[c.split()[0] for c in schema.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                ids, vectors = (c.to_pylist() for c in b.slice(lo, 256).columns)
                rows = []
                for i, v in zip(ids, vectors):
                    page = np.clip(np.floor((np.array(v, dtype=np.float32).astype(np.float64) + 0.5) * 255 + 0.5), 0, 255).astype(np.uint8).reshape(8, 8)
                    rows += [(i, *r) for r in kernel(page)]
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, k in zip(zip(*rows), names)] if rows else [pa.array([], kinds[k]) for k in names], names=names)

    arrow = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = {"page_id": pa.int64()} | {c.split()[0]: arrow[c.split()[1]] for c in schema.split(", ")}
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInArrow(run, f"page_id long, {schema}")


def pixels(img: np.ndarray) -> list[tuple]:
    return [(x, y, img[y, x].item()) for y in range(img.shape[0]) for x in range(img.shape[1])]


def colour(img: np.ndarray) -> np.ndarray:
    return np.repeat(img[..., None], 3, axis=2)


@query(SQL["max_filter"])
def raster_max_filter(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: pixels(R.max_filter(g, 2)), "x int, y int, m int")


@query(SQL["otsu_level"])
def raster_otsu_level(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: [(R.otsu_level(g),)], "level int")


@query(SQL["rotate_page"])
def raster_rotate(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: pixels(np.rot90(g, -1)), "x int, y int, g int")


@query(SQL["crop_with_padding"])
def raster_crop(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: pixels(R.crop(g, -3, 4, 10, 6)), "x int, y int, g int")


@query(COMPONENTS + ' SELECT page_id, "left", top, width, height, area FROM c')
def raster_components(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: R.components(g <= 90).tolist(), "left long, top long, width long, height long, area long")


@query(COMPONENTS + """ SELECT page_id, min("left") AS x, min(top) AS y, max("left" + width) - min("left") AS w, max(top + height) - min(top) AS h FROM c
WHERE area >= 3 AND "left" >= 1 AND top >= 1 AND "left" + width <= 7 AND top + height <= 7 GROUP BY page_id""")
def raster_content_box(spark, sf_dir):
    box = lambda g: [b] if (b := R.content_box(colour(g), 91)) else []
    return each_page(spark, sf_dir, box, "x long, y long, w long, h long")


@query(f"""WITH {PX}, i AS (SELECT *, (g <= avg(g) OVER (PARTITION BY page_id) - 15)::INT AS ink FROM px),
p AS (SELECT page_id, x, avg(ink) AS ink, avg(g) AS lum FROM i GROUP BY page_id, x),
s AS (SELECT page_id, x, lum, avg(ink) OVER w AS ink, avg(lum) OVER w AS near FROM p WINDOW w AS (PARTITION BY page_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
r AS (SELECT page_id, x, (1 - ink / greatest(max(ink) OVER (PARTITION BY page_id), 1e-9) + least(greatest((lum - near) / 40, 0), 1)) * (1 - abs(x / 8.0 - 0.5) / 0.15 * 0.3) AS score FROM s WHERE x BETWEEN 2 AND 4)
SELECT page_id, (x + 1)::INT AS gutter FROM r QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY round(score, 9) DESC, x) = 1""")
def raster_gutter(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: [(R.gutter(colour(g)),)], "gutter int")


_TAPS = "(SELECT unnest([-5, -4, -3, -2, -1, 0, 1, 2, 3, 4, 5]) AS d)"
_WEIGHT = "exp(-(d * d) / (2 * 1.6::DOUBLE * 1.6::DOUBLE))"


@query(f"""WITH {PX}, r AS (SELECT *, max(g) OVER (PARTITION BY page_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM px),
f AS (SELECT page_id, x, y, g, max(m) OVER (PARTITION BY page_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM r),
h AS (SELECT f.page_id, f.x, f.y, f.g, (sum(n.m * {_WEIGHT}) / sum({_WEIGHT}))::FLOAT AS m FROM f, {_TAPS} t JOIN f n ON n.page_id = f.page_id AND n.y = f.y AND n.x = least(greatest(f.x + d, 0), 7) GROUP BY ALL),
v AS (SELECT h.page_id, h.x, h.y, h.g, (sum(n.m::DOUBLE * {_WEIGHT}) / sum({_WEIGHT}))::FLOAT AS m FROM h, {_TAPS} t JOIN h n ON n.page_id = h.page_id AND n.x = h.x AND n.y = least(greatest(h.y + d, 0), 7) GROUP BY h.page_id, h.x, h.y, h.g)
SELECT page_id, x, y, least(greatest(floor(g::FLOAT * 255::FLOAT / greatest(floor(m + 0.5::FLOAT), 16)::FLOAT * 255::FLOAT / 235::FLOAT + 0.5::FLOAT), 0), 255)::INT AS g FROM v""")
def raster_even_light(spark, sf_dir):
    return each_page(spark, sf_dir, lambda g: pixels(R.even_light(colour(g), text=0.3, smooth=0.2)[..., 0]), "x int, y int, g int")


@query("""SELECT quality::VARCHAR AS book, doc_id::VARCHAR || '.jpg' AS file, (toxic = 1) AS skip, CASE WHEN doc_id % 2 = 0 THEN 90 END::INT AS rotate, CASE WHEN doc_id % 5 = 0 THEN 0 END::INT AS unwarp,
CASE WHEN doc_id % 3 = 0 THEN 'none' WHEN doc_id % 3 = 1 THEN 'at' END AS split_mode, CASE WHEN doc_id % 3 = 1 THEN round(doc_id % 10 / 10.0::DOUBLE, 6) END AS split_at,
CASE WHEN doc_id % 4 = 0 THEN 0.25::DOUBLE END AS x1 FROM labels
WHERE toxic = 1 OR doc_id % 2 = 0 OR doc_id % 5 = 0 OR doc_id % 3 <> 2 OR doc_id % 4 = 0""")
def override_json(spark, sf_dir):
    """Overrides written as JSON, one text a book, and read again."""
    d = F.col("doc_id")
    rows = table(spark, sf_dir, "labels").select(
        F.col("quality").cast("string").alias("book"), F.concat(d.cast("string"), F.lit(".jpg")).alias("file"), (F.col("toxic") == 1).alias("skip"), F.when(d % 2 == 0, 90).alias("rotate"),
        F.when(d % 5 == 0, False).alias("unwarp"), F.lit(None).cast("boolean").alias("unwarp_curl"), F.lit(None).cast("boolean").alias("dewarp"),
        F.when(d % 3 == 0, "none").when(d % 3 == 1, "at").alias("split_mode"), F.when(d % 3 == 1, F.round(d % 10 / 10.0, 6)).alias("split_at"),
        F.when(d % 4 == 0, F.create_map(F.lit(1).cast("tinyint"), F.struct(F.lit(0.25).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("w"), F.lit(0.5).alias("h")))).alias("content"),
    )
    back = overrides.parsed(overrides.written(rows))
    return back.select("book", "file", "skip", "rotate", F.col("unwarp").cast("int").alias("unwarp"), "split_mode", "split_at", F.try_element_at("content", F.lit(1).cast("tinyint"))["x"].alias("x1"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, l_discount * 8 AS x, l_tax * 10 AS y, l_quantity / 60 AS w, l_discount * 4 AS h FROM lineitem),
e AS (SELECT l_orderkey, l_linenumber, round(least(greatest(x, 0), 1) * 400)::BIGINT AS x0, round(least(greatest(x + w, 0), 1) * 400)::BIGINT AS x1,
  round(least(greatest(y, 0), 1) * 800)::BIGINT AS y0, round(least(greatest(y + h, 0), 1) * 800)::BIGINT AS y1 FROM b)
SELECT l_orderkey, l_linenumber, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM e WHERE x1 > x0 AND y1 > y0""")
def manual_boxes(spark, sf_dir):
    box = F.struct((F.col("l_discount") * 8).alias("x"), (F.col("l_tax") * 10).alias("y"), (F.col("l_quantity") / 60).alias("w"), (F.col("l_discount") * 4).alias("h"))
    out = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", overrides.to_px(box, F.lit(400), F.lit(800)).alias("b"))
    return out.filter("b is not null").select("l_orderkey", "l_linenumber", "b.*")


@query("""SELECT o_custkey, coalesce(max(CASE WHEN o_orderstatus <> 'P' AND o_orderkey * 100000 < 4294967296 THEN o_orderkey * 100000 END), 0) + 1 AS next FROM orders GROUP BY o_custkey""")
def upload_numbers(spark, sf_dir):
    name = F.concat(F.when(F.col("o_orderstatus") == "P", "page").otherwise(""), (F.col("o_orderkey") * 100000).cast("string"), F.lit(".jpg"))
    return B.next_numbers(table(spark, sf_dir, "orders").select("o_custkey", name.alias("file")), "o_custkey", "file")


@query("""WITH f AS (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ' (2)' ELSE '' END AS name FROM (SELECT s_suppkey, 'book ' || s_nationkey AS s_name FROM supplier))
SELECT count(*) AS books, count(*) AS outputs FROM f""")
def distinct_outputs(spark, sf_dir):
    """Names with and without numbers never clash: as many outputs as books."""
    s = table(spark, sf_dir, "supplier")
    name = F.concat(F.lit("book "), F.col("s_nationkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " (2)").otherwise(""))
    return B.output_names(s.select("s_suppkey", name.alias("name")), "name", ["s_suppkey"]).agg(F.count("*").alias("books"), F.countDistinct(F.lower("output")).alias("outputs"))
