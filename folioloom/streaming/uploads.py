"""Uploads as a stateful stream: files that arrive are numbered on from the largest number of their book, without gaps, over
batches and restarts; a book that has been quiet for a while is closed, and is then made anew.

State is one row a book: the largest number, and how many files came since the book was last closed. The numbers of a batch
that is repeated after a failure are the same again, since state goes back with the batch. Within a batch the files of a book
are numbered in the order in which they were sent, then by path; a task holds the names (never the contents) of one book's
files of one batch, which maxFilesPerTrigger bounds. Types that no page can have are left out and get no number.

Nulls: rows without a book or a file are left out. A null time of sending comes first. A file sent twice is two files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioloom.functions.scalars import extension, is_image
from folioloom.operators.books import next_numbers

#: A numbered file has number and stored; a closed book has files, the number of files since it was last closed.
SCHEMA = "book string, path string, file string, number long, stored string, files long"


class Numbering(StatefulProcessor):
    """The largest number of each book, and a timer that closes it idle milliseconds after its last file (None: no timer)."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("numbers", "largest long, fresh long")

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.state.update((initialState.next - 1, 0))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        largest, fresh = self.state.get() if self.state.exists() else (0, 0)
        for r in sorted(rows, key=lambda r: (r.sent is not None, r.sent, r.path) if r.sent is not None else (False, r.path)):
            largest, fresh = largest + 1, fresh + 1
            yield Row(book=key[0], path=r.path, file=r.file, number=largest, stored=f"{largest:04d}.{r.kind}", files=None)
        self.state.update((largest, fresh))
        if self.idle is None:
            return
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        largest, fresh = self.state.get()
        self.state.update((largest, 0))
        yield Row(book=key[0], path=None, file=None, number=None, stored=None, files=fresh)

    def close(self) -> None:
        pass


def numbered(arrived: DataFrame, stored: DataFrame | None = None, idle: int | None = 600_000) -> DataFrame:
    """SCHEMA rows of a stream of arrivals (book, path, file, sent): each file with its number and the name it is stored
    under, and a row for each book that closes. stored: files (book, file) that books have before the stream first starts.
    With idle None books don't close, and a stream that stops when all is read (availableNow) can end: one with timers goes on."""
    spark = arrived.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = arrived.filter(F.col("book").isNotNull() & is_image(F.regexp_replace("file", "^[_.]+", "")))
    rows = rows.select("book", "path", "file", "sent", extension(F.col("file")).alias("kind"))
    first = next_numbers(stored, "book", "file").groupBy("book") if stored is not None else None
    return rows.groupBy("book").transformWithState(Numbering(idle), SCHEMA, "Append", "None" if idle is None else "ProcessingTime", first)


def stored_files(rows: DataFrame, root: str) -> DataFrame:
    """Copy each numbered file to its book below root. Lazy: an action on the result (book, stored, length) copies. A file
    is written under a name of the task's own, then moved, so that a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(root)
        for b in batches:
            sizes = []
            for book, path, name in zip(*(b[c].to_pylist() for c in ("book", "path", "stored"))):
                source, at = fs.FileSystem.from_uri(path)
                to = f"{base}/{book}/{name}" if book else f"{base}/{name}"
                store.create_dir(to.rsplit("/", 1)[0], recursive=True)
                part = "/_".join(to.rsplit("/", 1)) + ".part"
                with source.open_input_stream(at) as read, store.open_output_stream(part) as write:
                    n = 0
                    while data := read.read(1 << 20):
                        write.write(data)
                        n += len(data)
                store.move(part, to)
                sizes.append(n)
            yield pa.record_batch([b["book"], b["stored"], pa.array(sizes, pa.int64())], names=["book", "stored", "length"])

    return rows.filter("number is not null").select("book", "path", "stored").mapInArrow(run, "book string, stored string, length long")


def take_in(
    arrived: DataFrame, root: str, checkpoint: str, stored: DataFrame | None = None, idle: int = 600_000,
    rebuild: Callable[[DataFrame, int], None] | None = None, every: str = "10 seconds",
) -> StreamingQuery:
    """Store what arrives below root, numbered, and call rebuild with the books (book, files) of each batch that closed, and
    the batch's number. A batch may be repeated after a failure: it stores the same files again, and rebuild should replace
    what it made."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.persist()
        try:
            stored_files(rows, root).write.format("noop").mode("overwrite").save()
            closed = rows.filter("files > 0").select("book", "files")
            if rebuild and not closed.isEmpty():
                rebuild(closed, number)
        finally:
            rows.unpersist()

    return numbered(arrived, stored, idle).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def stored_already(spark: SparkSession, root: str) -> DataFrame:
    """book and file of what is below root, for numbered()."""
    from folioloom.sources import folio

    return folio.listing(spark, root, heads=False).select("book", "file")
