"""Libraries of books: listings over several roots, what is done already, thumbnails, uploads, summaries of reports."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioloom.functions import jpeg, rasters
from folioloom.functions.scalars import extension, is_image, natural_key, tree_key

from .books import next_numbers


def over_roots(found: list[DataFrame], key: str = "book") -> DataFrame:
    """Books of several roots, in the order of the roots, then of the trees; of a book found twice the first one stays."""
    rows = reduce(DataFrame.unionByName, [f.withColumn("root", F.lit(i)) for i, f in enumerate(found)])
    turn = F.row_number().over(Window.partitionBy(key).orderBy("root"))
    return rows.withColumn("__n", turn).filter("__n = 1").drop("__n").orderBy("root", tree_key(F.col(key)))


def newest_first(books: DataFrame, done: DataFrame, key: str = "book") -> DataFrame:
    """Visible books with pdf, whether done has them; the ones changed last come first."""
    out = books.join(done.select(key).distinct().withColumn("pdf", F.lit(True)), key, "left").withColumn("pdf", F.coalesce("pdf", F.lit(False)))
    return out.filter(~F.col(key).rlike("(^|/)[_.]")).orderBy(F.desc_nulls_last("modified"), key)


def without_done(books: DataFrame, done: DataFrame, key: str, skip: bool = True) -> DataFrame:
    """Books whose output does not exist; all of them if skip is off."""
    return books.join(done.select(key).distinct(), key, "left_anti") if skip else books


def added(listed: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """listed and those of incoming that it lacks, each once."""
    return listed.unionByName(incoming.dropDuplicates([key]).join(listed.select(key).distinct(), key, "left_anti"))


def folder_info(images: DataFrame, overrides: DataFrame) -> DataFrame:
    """The images of each book in natural order, with the overrides of each."""
    return images.join(overrides, ["book", "file"], "left").orderBy(tree_key(F.col("book")), natural_key(F.col("file")), "file")


def upload_names(incoming: DataFrame, stored: DataFrame, order: list) -> DataFrame:
    """Incoming files (book, file) of supported types with the name that each gets: four digits, counted on from the book's
    largest, in the order in which they were sent."""
    rows = incoming.filter(is_image(F.regexp_replace("file", "^[_.]+", "")))
    turn = F.row_number().over(Window.partitionBy("book").orderBy(*order)) - 1
    rows = rows.join(next_numbers(stored, "book", "file"), "book", "left").withColumn("n", F.coalesce("next", F.lit(1)) + turn)
    return rows.withColumn("stored", F.concat(F.format_string("%04d.", "n"), extension(F.col("file")))).drop("n", "next")


def thumbnails(pages: DataFrame, most: int, quality: int = 82) -> DataFrame:
    """path and a JPEG data URL of each page (path, width, height, data), its longer side at most so long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):  # one page at a time: rasters are large
                path, w, h, data = (c[0].as_py() for c in row.columns)
                s = min(most / max(w, h), 1.0)
                img = np.frombuffer(data, dtype=np.uint8).reshape(h, w, 3)
                small = rasters.resize(img, max(int(w * s), 1), max(int(h * s), 1)) if s < 1 else img
                url = "data:image/jpeg;base64," + base64.b64encode(jpeg.encode(small, quality)).decode()
                yield pa.record_batch([pa.array([path]), pa.array([url])], names=["path", "url"])

    return pages.select("path", "width", "height", "data").mapInArrow(run, "path string, url string")


def summary(report: DataFrame) -> DataFrame:
    """One line a page of a report, as text."""
    skew = F.when(F.col("deskewed"), F.format_string("%+.2f", "angle")).otherwise("-")
    bend = F.when(F.col("straightened"), F.format_string("%.1f px", "bend")).otherwise("-")
    return report.select("book", "file", "half", F.coalesce(F.concat(F.lit("error: "), "error"), F.concat(F.lit("skew "), skew, F.lit(", bend "), bend)).alias("line"))


def box_for(long_side: int) -> dict:
    """The page box and the resolution of A4 pages with this longer side."""
    return {"page_box": (int(long_side * 2480 / 3508 + 0.5), long_side), "dpi": 300 * long_side / 3508}


def counts(rows: DataFrame, by: list[str], failed: Column) -> DataFrame:
    """Rows and failures of each group."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
