"""Incremental ingestion: images arrive in book folders, and each book that got any is made anew as a whole, since its layout
depends on all its pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from folioloom.sources.folders import listed

#: What Spark's source of files gives.
FILES = "path string, modificationTime timestamp, length long, content binary"


def arrivals(spark: SparkSession, root: str, exclude: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the images that arrive below root: path, book, file, length and modified; contents are not read."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return listed(reader.load(root), root, exclude)


def follow(arrived: DataFrame, rebuild: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Call rebuild with the books (distinct names, never empty) of each batch and its number. A batch may be repeated after
    a failure, so rebuild should replace what it made. once: stop when all that has arrived is done."""

    def batch(rows: DataFrame, number: int) -> None:
        books = rows.select("book").distinct()
        if not books.isEmpty():
            rebuild(books, number)

    writer = arrived.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
