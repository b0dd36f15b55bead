"""Folders of page images as relations: listing, books, and decoded pages.

Listings never read the files' contents (Spark prunes the column). Pages are decoded by Spark's image source in the JVM, from
the content of each file (JPEG, PNG, BMP, GIF, TIFF). What the files' heads say comes from the source in folio.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.scalars import is_image, natural_key, parent, tree_key

from .work import kept

#: Images up to which their list is broadcast.
BROADCAST_ROWS = 100_000


def below(path: Column, root: str) -> Column:
    """The path below root, without the scheme of the file system."""
    plain = lambda c: F.regexp_replace(c, "^[a-z0-9]+:/+", "/")
    return F.substr(F.url_decode(F.replace(plain(path), F.lit("+"), F.lit("%2B"))), F.length(plain(F.lit(root.rstrip("/")))) + 2)


def images(spark: SparkSession, root: str, exclude: str | None = None, recursive: bool = True) -> DataFrame:
    """path, book (folder below root; empty for root itself), file, length and modified of each visible image."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    return listed(found, root, exclude)


def listed(found: DataFrame, root: str, exclude: str | None = None) -> DataFrame:
    """The same of a relation of files, which may be a stream."""
    rows = found.select("path", below(F.col("path"), root).alias("rel"), F.col("length").alias("length"), F.col("modificationTime").alias("modified"))
    rows = rows.select("path", F.when(F.contains("rel", F.lit("/")), parent(F.col("rel"))).otherwise("").alias("book"), F.substring_index("rel", "/", -1).alias("file"), "length", "modified")
    rows = rows.filter(is_image(F.col("file")) & ~F.col("book").rlike("(^|/)[_.]"))
    if exclude is not None:
        rows = rows.filter((F.col("book") != exclude) & ~F.startswith("book", F.lit(f"{exclude}/")))
    return rows


def books(found: DataFrame) -> DataFrame:
    """book, n_images and the newest change of each folder that has images, with its sort key."""
    return found.groupBy("book").agg(F.count("*").alias("n_images"), F.max("modified").alias("modified")).withColumn("key", tree_key(F.col("book")))


def ordered(found: DataFrame) -> DataFrame:
    """All images, book after book, in natural order of names."""
    return found.orderBy(tree_key(F.col("book")), natural_key(F.col("file")), "file")


def turned(x: np.ndarray, how: int) -> np.ndarray:
    """A raster (rows, columns, channels) put upright."""
    if how in (5, 6, 7, 8):
        x = x.swapaxes(0, 1)
    if how in (2, 3, 6, 7):
        x = x[:, ::-1]
    if how in (3, 4, 7, 8):
        x = x[::-1]
    return x


def rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Spark's raster (grey, BGR or BGRA) as RGB over white."""
    x = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(x, 3, axis=2)
    if channels == 4:
        a = x[..., 3:].astype(np.uint32)
        return ((x[..., 2::-1] * a + 255 * (255 - a)) // 255).astype(np.uint8)
    return x[..., ::-1]


def _upright(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "book", "file", "width", "height", "channels", "data", "error"]
    for b in batches:
        for row in (b.slice(i, 1) for i in range(b.num_rows)):  # one page at a time: rasters are large
            path, book, file, how, width, height, channels, data = (c[0].as_py() for c in row.columns)
            error = None
            try:
                if width <= 0:
                    raise ValueError("the image can't be decoded")
                x = turned(rgb(data, width, height, channels), how)
                size, data = (x.shape[1], x.shape[0], 3), x.tobytes()
            except ValueError as e:
                size, data, error = (None, None, None), None, str(e)
            cols = [pa.array([v], pa.string()) for v in (path, book, file)] + [pa.array([n], pa.int32()) for n in size]
            yield pa.record_batch([*cols, pa.array([data], pa.binary()), pa.array([error], pa.string())], names=names)


PAGES = "path string, book string, file string, width int, height int, channels int, data binary, error string"


def visible(rel: Column) -> Column:
    """Whether a path below the root is an image of a book that is looked at."""
    return is_image(F.substring_index(rel, "/", -1)) & ~rel.rlike("(^|/)[_.][^/]*/")


def upright(spark: SparkSession, root: str, found: DataFrame, books: list[str] | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """PAGES rows of found (path, book, file, orientation, error, rel: the path below root): rasters decoded in the JVM and put
    upright, or the reason why there is none. Filters on the path choose the files before any is opened."""
    heads = kept(found, "listing")
    rel = below(F.col("_metadata.file_path"), root)
    raw = spark.read.format("image").option("dropInvalid", "false").option("recursiveFileLookup", "true").load(root).filter(visible(rel))
    if books is not None:
        raw = raw.filter(F.when(F.contains(rel, F.lit("/")), parent(rel)).otherwise("").isin(books))
    if part[1] > 1:
        raw = raw.filter(F.crc32(rel) % part[1] == part[0])
    raw = raw.select(rel.alias("rel"), "image.width", "image.height", "image.nChannels", "image.data")
    good, bad = heads.filter("error is null"), heads.filter("error is not null")
    side = F.broadcast(good) if good.count() <= BROADCAST_ROWS else good  # rasters stay where they are decoded
    out = raw.join(side, "rel").select("path", "book", "file", "orientation", "width", "height", "nChannels", "data").mapInArrow(_upright, PAGES)
    none = [F.lit(None).cast(t).alias(c) for c, t in (("width", "int"), ("height", "int"), ("channels", "int"), ("data", "binary"))]
    return out.unionByName(bad.select("path", "book", "file", *none, "error"))
