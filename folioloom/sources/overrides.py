"""Manual overrides of pages, one JSON file in a book's folder: {"pages": {file: {...}}}, names in camel case, what is absent
follows the options."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.functions.scalars import clamp, parent

from .folders import below

FILE = "overrides.json"
_PAGE = "skip boolean, rotate int, unwarp boolean, unwarpCurl boolean, dewarp boolean, split string, content map<string, struct<x double, y double, w double, h double>>"
COLUMNS = ("skip", "rotate", "unwarp", "unwarp_curl", "dewarp", "split_mode", "split_at", "content")


def parsed(texts: DataFrame, text: str = "json") -> DataFrame:
    """One row for each page that a text names: the other columns, file (path below the book's folder) and the overrides."""
    keep = [c for c in texts.columns if c != text]
    found = texts.select(*keep, F.from_json(text, f"pages map<string, struct<{_PAGE}>>")["pages"].alias("pages"))
    rows = found.select(*keep, F.explode("pages").alias("file", "o"))
    at = F.get_json_object("o.split", "$.at").cast("double")
    return rows.select(
        *keep, "file", F.coalesce("o.skip", F.lit(False)).alias("skip"), "o.rotate", "o.unwarp", F.col("o.unwarpCurl").alias("unwarp_curl"), "o.dewarp",
        F.when(at.isNotNull(), "at").when(F.col("o.split") == "none", "none").alias("split_mode"), at.alias("split_at"),
        F.transform_keys("o.content", lambda k, _: k.cast("tinyint")).alias("content"),
    )


def texts(spark: SparkSession, root: str, name: str = FILE) -> DataFrame:
    """book and json of the files of all books below root."""
    found = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root)
    rel = below(F.col("_metadata.file_path"), root)
    return found.select(F.when(F.contains(rel, F.lit("/")), parent(rel)).otherwise("").alias("book"), F.col("value").alias("json"))


def load(spark: SparkSession, root: str, name: str = FILE) -> DataFrame:
    """book, file and the overrides of all books below root."""
    return parsed(texts(spark, root, name))


def overridden() -> Column:
    """Whether a row overrides anything."""
    some = F.coalesce("unwarp", "unwarp_curl", "dewarp").isNotNull() | F.col("rotate").isNotNull() | F.col("split_mode").isNotNull()
    return some | F.coalesce("skip", F.lit(False)) | (F.coalesce(F.size("content"), F.lit(0)) > 0)


def written(overrides: DataFrame) -> DataFrame:
    """book and json: the file of each book, null where nothing is overridden. Null and false items are left out; of rows
    that name the same file, one stays."""
    at = F.parse_json(F.to_json(F.struct(F.col("split_at").alias("at"))))
    entry = F.struct(
        F.when(F.col("skip"), True).alias("skip"), "rotate", "unwarp", F.col("unwarp_curl").alias("unwarpCurl"), "dewarp",
        F.when(F.col("split_mode") == "at", at).when(F.col("split_mode") == "none", F.parse_json(F.lit('"none"'))).alias("split"),
        F.when(F.size("content") > 0, F.transform_keys("content", lambda k, _: k.cast("string"))).alias("content"),
    )
    rows = overrides.select("book", "file", F.when(overridden(), F.to_json(entry)).alias("entry"))
    # entries are one a file, as text, and become JSON again within the map: nothing is cut out of serialised text
    pages = rows.groupBy("book", "file").agg(F.max("entry").alias("entry")).groupBy("book")
    some = F.sort_array(F.collect_list(F.when(F.col("entry").isNotNull(), F.struct("file", "entry"))))
    lines = pages.agg(some.alias("lines"))
    whole = F.map_from_entries(F.transform("lines", lambda x: F.struct(x["file"], F.parse_json(x["entry"]))))
    return lines.select("book", F.when(F.size("lines") > 0, F.concat(F.to_json(F.struct(whole.alias("pages"))), F.lit("\n"))).alias("json"))


def unreadable(texts: DataFrame, text: str = "json") -> DataFrame:
    """The other columns of texts that are no JSON, with an error: parsed() has no row for them."""
    return texts.filter(F.col(text).isNotNull() & F.try_parse_json(text).isNull()).drop(text).withColumn("error", F.lit("the overrides can't be read"))


def save(overrides: DataFrame, root: str, name: str = FILE) -> DataFrame:
    """Write each book's file; remove it where nothing is overridden. Lazy: an action on the result (book, kept) writes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            for book, text in zip(*(c.to_pylist() for c in b.columns)):
                path = f"{base}/{book}/{name}" if book else f"{base}/{name}"
                if text is not None:
                    with store.open_output_stream(path) as out:
                        out.write(text.encode())
                elif store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_file(path)
            yield pa.record_batch([b.column(0), b.column(1).is_valid()], names=["book", "kept"])

    return written(overrides).mapInArrow(run, "book string, kept boolean")


def to_px(box: Column, width: Column, height: Column) -> Column:
    """A box in shares of a page as pixels; null if it holds none."""
    x0, x1 = (F.round(clamp(v, 0.0, 1.0) * width).cast("long") for v in (box["x"], box["x"] + box["w"]))
    y0, y1 = (F.round(clamp(v, 0.0, 1.0) * height).cast("long") for v in (box["y"], box["y"] + box["h"]))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))
