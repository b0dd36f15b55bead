"""Progress of conversions and of streams, as a table of events.

A conversion works through its images in parts (a share of the paths' hashes each). Every part is written and committed
before it counts: done is the number of images in committed parts, so a task or a part that ran twice counts once, and a
conversion that was broken off goes on behind its last committed part. Parts also carry an Observation, whose pages and
errors are reported with the event; what counts is what was committed.

Streams report through a listener: each micro-batch with observed metrics gives a row, and a batch that was repeated after
a failure replaces its row.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from folioloom.functions import scalars

#: kind: processed, encoded or finished; file: where a finished book is; pages and errors: of the last part.
EVENT = "n long, kind string, book string, done long, total long, file string, pages long, errors long"


class Progress:
    """Events of one conversion, below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _exists(self, path: str) -> bool:
        store, at = fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
        return store.get_file_info(at).type != fs.FileType.NotFound

    def part(self, i: int) -> str:
        return f"{self.folder}/pages/part={i}"

    def committed(self, i: int) -> bool:
        return self._exists(f"{self.part(i)}/_SUCCESS")

    def write(self, pages: DataFrame, i: int) -> dict:
        """Write a part; what was observed on the way."""
        seen = Observation(f"part-{i}")
        pages.observe(seen, F.count_if(F.col("error").isNull()).alias("pages"), F.count("error").alias("errors")).write.mode("overwrite").parquet(self.part(i))
        return seen.get

    def pages(self, parts: int, schema) -> DataFrame:
        """All committed parts."""
        there = [self.part(i) for i in range(parts) if self.committed(i)]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def add(self, n: int, kind: str, counts: DataFrame, totals: DataFrame, observed: dict | None = None) -> None:
        """Add the event numbered n of each book of totals (book, total); counts: book and done, perhaps file. An event that
        is added again replaces itself."""
        seen = observed or {}
        file = F.col("file") if "file" in counts.columns else F.lit(None).cast("string")
        rows = totals.join(counts.select("book", "done", file.alias("file")), "book", "left")
        rows = rows.select(F.lit(n).cast("long").alias("n"), F.lit(kind).alias("kind"), "book", F.coalesce("done", F.lit(0)).cast("long").alias("done"), F.col("total").cast("long").alias("total"), "file", F.lit(seen.get("pages")).cast("long").alias("pages"), F.lit(seen.get("errors")).cast("long").alias("errors"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/events/{kind}-{n}")

    def events(self) -> DataFrame:
        """EVENT rows so far."""
        if not self._exists(f"{self.folder}/events"):
            return self.spark.createDataFrame([], EVENT)
        return self.spark.read.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/events")


def current(events: DataFrame, sharpen: bool = False) -> DataFrame:
    """book, kind, done, total, and share (of the whole conversion; null when finished) of the last event of each book."""
    stage = F.element_at(F.create_map(*[F.lit(x) for pair in (("processed", 1), ("sharpened", 2), ("encoded", 3), ("finished", 4)) for x in pair]), F.col("kind"))
    last = F.row_number().over(Window.partitionBy("book").orderBy(F.desc(stage), F.desc("n")))
    rows = events.withColumn("__turn", last).filter("__turn = 1")
    return rows.select("book", "kind", "done", "total", scalars.progress(F.col("kind"), F.col("done"), F.col("total"), sharpen).alias("share"))


def line(events: DataFrame) -> DataFrame:
    """events with a line of text each, as for a console."""
    counts = F.format_string("%s: %s %d/%d", "book", "kind", "done", "total")
    return events.withColumn("line", F.when(F.col("kind") == "finished", F.format_string("%s: finished, %s", "book", F.coalesce("file", F.lit("no file")))).otherwise(counts))


class StreamProgress(StreamingQueryListener):
    """Writes a JSON line for each micro-batch of queries that observe metrics under a name: rows of (query, batch, at, rows)
    and the metrics. One small file a query run below folder; batches() keeps the last line of each batch."""

    def __init__(self, folder: str, name: str):
        self.folder, self.name = folder.rstrip("/"), name
        self.lines: dict[str, dict[int, str]] = {}

    def onQueryStarted(self, event) -> None:
        self.lines[str(event.runId)] = {}

    def onQueryProgress(self, event) -> None:
        p = event.progress
        metrics = p.observedMetrics.get(self.name)
        if metrics is None or not p.numInputRows:
            return
        row = {"query": str(p.id), "batch": p.batchId, "at": datetime.now(UTC).isoformat(), "rows": p.numInputRows, "metrics": metrics.asDict()}
        own = self.lines.setdefault(str(p.runId), {})
        own[p.batchId] = json.dumps(row)
        self._save(str(p.runId), own)

    def _save(self, run: str, own: dict[int, str]) -> None:
        store, base = fs.FileSystem.from_uri(self.folder if ":/" in self.folder else f"file://{self.folder}")
        store.create_dir(base, recursive=True)
        part = f"{base}/_{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write("".join(f"{own[k]}\n" for k in sorted(own)).encode())
        store.move(part, f"{base}/{run}.jsonl")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def batches(self, spark: SparkSession) -> DataFrame:
        """query, batch, at, rows and metrics (name to number), once a batch."""
        found = spark.read.schema("query string, batch long, at timestamp, rows long, metrics map<string, long>").json(self.folder)
        turn = F.row_number().over(Window.partitionBy("query", "batch").orderBy(F.desc("at")))
        return found.withColumn("__turn", turn).filter("__turn = 1").drop("__turn")
