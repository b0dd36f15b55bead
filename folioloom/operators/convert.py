"""From page images to clean books: each image becomes upright, evenly lit pages (one stage, image by image), the book's
layout is an aggregate over the boxes of its pages, and the finished pages are cut to one size and encoded.

Rasters are shuffled once, encoded, by book, on their way into the PDF sink; layouts join by their few small columns. An image
that can't be read, decoded or processed gives a row with its error and no page, and the others of its book go on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions import jpeg, lines, rasters
from folioloom.functions.scalars import natural_key
from folioloom.sources import folders, folio, overrides, pdf
from folioloom.sources.work import kept

from . import books
from .progress import Progress

#: The box of a page (A4 at 300 dpi) and what is done unless options say otherwise.
OPTIONS = {
    "page_box": (2480, 3508), "rotate": 0, "unwarp": False, "split": True, "min_aspect": 1.15, "deskew": True, "dewarp": True,
    "illumination": True, "layout": True, "margin": 0.05, "ink_below": 160, "quality": 85, "dpi": 300.0, "auto_grey": True, "max_pages": None,
}
_BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
PAGE = f"book string, file string, half tinyint, width int, height int, gutter_x int, angle double, deskewed boolean, straightened boolean, bend double, box {_BOX}, error string, data binary"


def halves(img: np.ndarray, split: str, at: float | None, options: dict) -> tuple[list[np.ndarray], int | None]:
    """An image as one page or two, and where it was cut."""
    h, w = img.shape[:2]
    x = None
    if split == "at":
        x = int(at * w + 0.5)
    elif split == "always" or split == "auto" and w >= h * options["min_aspect"]:
        x = rasters.gutter(img)
    return ([img[:, :x], img[:, x:]], x) if x is not None and 0 < x < w else ([img], None)


def one_page(img: np.ndarray, box: dict | None, dewarp: bool, options: dict) -> tuple[np.ndarray, dict]:
    """A page fitted, turned upright, straightened and evenly lit, with what was found on the way. box: a manual one."""
    img = rasters.fit(img, *options["page_box"])
    angle, applied = None, False
    if options["deskew"]:
        img, angle, applied = rasters.deskew(img)
    straight, bend = False, None
    if dewarp:
        img, straight, bend = lines.straighten(img)
    if options["illumination"]:
        img = rasters.even_light(img)
    found = rasters.content_box(img, options["ink_below"]) if options["layout"] and not box else None
    return img, {"angle": angle, "deskewed": applied, "straightened": straight, "bend": bend, "box": dict(zip("xywh", found)) if found else None}


def process(images: DataFrame, options: dict | None = None) -> DataFrame:
    """PAGE rows of images (book, file, width, height, data, error, and rotate, split, split_at, dewarp, content as resolve
    gives them). An image with an error passes with it, and one that a kernel fails on gets one. Manual boxes, which are in
    shares of the finished page, travel with their page."""
    options = OPTIONS | (options or {})
    schema = pa.schema([("book", pa.string()), ("file", pa.string()), ("half", pa.int8()), ("width", pa.int32()), ("height", pa.int32()), ("gutter_x", pa.int32()), ("angle", pa.float64()), ("deskewed", pa.bool_()), ("straightened", pa.bool_()), ("bend", pa.float64()), ("box", pa.struct([(c, pa.int64()) for c in "xywh"])), ("error", pa.string()), ("data", pa.binary()), ("manual", pa.struct([(c, pa.float64()) for c in "xywh"]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):  # one image at a time: rasters are large
                pages, error = [], row["error"]
                try:
                    if error is None:
                        img = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], 3)
                        parts, x = halves(np.rot90(img, -(row["rotate"] // 90 % 4)), row["split"], row["split_at"], options)
                        for half, part in enumerate(parts):
                            manual = dict(row["content"] or {}).get(half)
                            out, found = one_page(part, manual, row["dewarp"], options)
                            pages.append({"half": half if len(parts) > 1 else None, "width": out.shape[1], "height": out.shape[0], "gutter_x": x, "data": out.tobytes(), "manual": manual} | found)
                except Exception as e:  # whatever a kernel meets in one image, the others go on
                    pages, error = [], f"{type(e).__name__}: {e}"
                for page in pages or [{"error": error}]:
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | {"book": row["book"], "file": row["file"]} | page], schema)

    cols = images.select("book", "file", "width", "height", "data", "error", "rotate", "split", "split_at", "dewarp", "content")
    pages = cols.mapInArrow(run, f"{PAGE}, manual struct<x:double,y:double,w:double,h:double>")
    box = overrides.to_px(F.col("manual"), F.col("width"), F.col("height"))
    return pages.withColumn("box", F.coalesce(box, "box")).drop("manual") if options["layout"] else pages.drop("manual")


def numbered(pages: DataFrame) -> DataFrame:
    """Pages that hold a raster, with their place in the book."""
    return books.page_order(pages.filter("error is null"), "book", "file", "half")


def finished(pages: DataFrame, options: dict | None = None) -> DataFrame:
    """book, page_idx, width, height, channels and data (JPEG) of every page of process(): white outside its box, cut to its
    book's size, grey if it has no colour. pages is read twice, so it should be kept."""
    options = OPTIONS | (options or {})
    place = numbered(pages.drop("data"))
    if options["layout"]:
        flat = place.select("book", "page_idx", F.col("width").cast("long").alias("pw"), F.col("height").cast("long").alias("ph"), "box.*")
        place = place.join(books.plan_crops(flat, "book", options["margin"]), ["book", "page_idx"])
    else:
        place = place.select("*", F.col("width").alias("out_w"), F.col("height").alias("out_h"), F.lit(0).alias("ox"), F.lit(0).alias("oy"))
    place = kept(place.select("book", "file", F.coalesce("half", F.lit(0)).alias("part"), "page_idx", "out_w", "out_h", "ox", "oy"), "places")
    if place.count() <= folders.BROADCAST_ROWS:  # rasters stay where they are; else they are dealt by page
        place = F.broadcast(place)
    rows = pages.filter("error is null").withColumn("part", F.coalesce("half", F.lit(0))).join(place, ["book", "file", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                img = np.frombuffer(r["data"], dtype=np.uint8).reshape(r["height"], r["width"], 3)
                if r["box"] and options["layout"]:
                    img = rasters.fill_outside(img, tuple(r["box"].values()))
                img = rasters.crop(img, r["ox"], r["oy"], r["out_w"], r["out_h"])
                plain = options["auto_grey"] and rasters.is_grey(img)
                data = jpeg.encode(rasters.grey(img) if plain else img, options["quality"])
                cols = [pa.array([r["book"]]), pa.array([r["page_idx"]], pa.int32()), *(pa.array([n], pa.int32()) for n in (img.shape[1], img.shape[0], 1 if plain else 3)), pa.array([data], pa.binary())]
                yield pa.record_batch(cols, names=["book", "page_idx", "width", "height", "channels", "data"])

    rows = rows.select("book", "page_idx", "width", "height", "box", "data", "ox", "oy", "out_w", "out_h")
    return rows.mapInArrow(run, "book string, page_idx int, width int, height int, channels int, data binary")


def names(listed: DataFrame) -> DataFrame:
    """book and name, the path of its output below the target without the ending, of all books of a listing."""
    own = F.when(F.col("book") == "", "book").otherwise(F.substring_index("book", "/", -1))
    found = books.output_names(folders.books(listed).withColumn("name", own), "name", [natural_key(F.col("book")), "book"])
    return found.select("book", F.regexp_replace("output", r"\.pdf$", "").alias("name"))


def convert(
    spark: SparkSession, root: str, target: str, options: dict | None = None, rtl: bool = False, work: str | None = None,
    only: list[str] | None = None, progress: Progress | None = None, parts: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Every book below root (or those named in only) becomes target/<name>.pdf. Gives the books written (name, n_pages,
    n_bytes) and the report: what process() found on each page, without the rasters. With progress the images are worked
    through in so many parts, each an event when it is committed, and a call with the same folder goes on where one was
    broken off."""
    options = OPTIONS | (options or {})
    manual = overrides.load(spark, root)
    every = kept(folio.listing(spark, root, heads=False).select("book", "file", "modified"), "images", work)
    listed = every if only is None else every.filter(F.col("book").isin(only))
    # what is skipped, or beyond the first pages, is settled on names alone
    wanted = books.resolve(listed.select("book", "file"), manual.drop("content"), ["book", "file"], options).select("book", "file")
    if options["max_pages"] is not None:
        wanted = books.page_order(wanted, "book", "file", limit=options["max_pages"]).drop("page_idx")

    def part(i: int, n: int) -> DataFrame:
        images = folio.pages(spark, root, only=wanted, books=only, part=(i, n)).withColumn("flattened", F.lit(False))  # there is no learned flattening here
        return process(books.resolve(images, manual, ["book", "file"], options, flattened="flattened").drop("flattened"), options)

    if progress is None:
        pages = kept(part(0, 1), "pages", work)
    else:
        totals = kept(wanted.groupBy("book").agg(F.count("*").alias("total")), "totals", work)
        for i in range(parts):
            seen = {} if progress.committed(i) else progress.write(part(i, parts), i)
            done = progress.pages(parts, PAGE).groupBy("book").agg(F.countDistinct("file").alias("done"))
            progress.add(i, "processed", done, totals, seen)
        pages = progress.pages(parts, PAGE)
    named = kept(names(every), "names", work)  # of all books: what one is called depends on the others
    out = finished(pages, options).join(named, "book").withColumn("dpi", F.lit(options["dpi"]))
    done = pdf.write(out, target, rtl)
    if progress is not None:
        sheets = pages.groupBy("book").agg(F.count_if(F.col("error").isNull()).alias("total"))
        written = named.join(done, "name").select("book", F.col("n_pages").alias("done"), F.concat(F.lit(f"{target}/"), "name", F.lit(".pdf")).alias("file"))
        progress.add(0, "encoded", written, sheets)
        progress.add(0, "finished", written, sheets)
    return done, pages.drop("data")


def status(report: DataFrame) -> DataFrame:
    """book, images, pages and errors of a report."""
    return report.groupBy("book").agg(F.countDistinct("file").alias("images"), F.count(F.when(F.col("error").isNull(), 1)).alias("pages"), F.count("error").alias("errors"))
