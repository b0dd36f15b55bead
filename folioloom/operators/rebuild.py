"""Books are made anew where something changed: an image, what is overridden by hand, the options, the name of the output, or
the output itself.

A manifest is one row an input: (book, kind, name, mark). Kinds are image (mark: length and time), override (a digest of the
file's overrides), output (the name it is written under) and options (a digest, once a book). The difference of two
manifests is one full join; the books it names are converted, and only when all are written does the new manifest take the
place of the old one, as a further version in the folder. A rebuild that fails leaves the old version, so that the next one
does the work. Books whose images are all gone are reported, and their outputs stay.
"""

from __future__ import annotations

import json
from hashlib import sha256

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioloom.sources import folio, overrides
from folioloom.sources.work import kept

from . import convert

SCHEMA = "book string, kind string, name string, mark string"


def snapshot(spark: SparkSession, root: str, options: dict | None = None, exclude: str | None = None) -> DataFrame:
    """The manifest of what is below root."""
    listed = kept(folio.listing(spark, root, exclude, heads=False).select("book", "file", "length", "modified"), "inputs")
    images = listed.select("book", F.lit("image").alias("kind"), F.col("file").alias("name"), F.concat_ws(":", F.col("length").cast("string"), F.unix_micros("modified").cast("string")).alias("mark"))
    books = listed.select("book").distinct()
    manual = overrides.load(spark, root)
    digest = F.sha2(F.to_json(F.struct(*[c for c in manual.columns if c not in ("book", "file")])), 256)
    manual = manual.filter(overrides.overridden()).join(books, "book", "left_semi").select("book", F.lit("override").alias("kind"), F.col("file").alias("name"), digest.alias("mark"))
    names = convert.names(listed).select("book", F.lit("output").alias("kind"), F.lit("").alias("name"), F.col("name").alias("mark"))
    chosen = sha256(json.dumps(convert.OPTIONS | (options or {}), sort_keys=True, default=str).encode()).hexdigest()
    settings = books.select("book", F.lit("options").alias("kind"), F.lit("").alias("name"), F.lit(chosen).alias("mark"))
    return images.unionByName(manual).unionByName(names).unionByName(settings)


def difference(old: DataFrame, new: DataFrame) -> DataFrame:
    """book, kind, name and change (added, removed, changed) of what is not the same in both manifests."""
    keys = ["book", "kind", "name"]
    both = old.withColumnRenamed("mark", "was").join(new.withColumnRenamed("mark", "now"), keys, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return both.select(*keys, change.alias("change")).filter("change is not null")


class Versions:
    """Manifests in a folder, a subfolder each; the last whole one counts."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def last(self) -> int:
        store, base = fs.FileSystem.from_uri(self.folder if ":/" in self.folder else f"file://{self.folder}")
        found = store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        whole = [i.path.rsplit("/", 2)[1] for i in found if i.base_name == "_SUCCESS"]
        return max((int(x.removeprefix("version=")) for x in whole if x.startswith("version=")), default=0)

    def read(self) -> DataFrame:
        n = self.last()
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/version={n}") if n else self.spark.createDataFrame([], SCHEMA)

    def write(self, manifest: DataFrame) -> int:
        n = self.last() + 1
        manifest.write.mode("overwrite").parquet(f"{self.folder}/version={n}")
        return n


def without_output(spark: SparkSession, manifest: DataFrame, target: str) -> DataFrame:
    """Books of a manifest whose output is not below target."""
    store, base = fs.FileSystem.from_uri(target)
    if store.get_file_info(base).type != fs.FileType.Directory:
        return manifest.select("book").distinct()
    written = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pdf").load(target)
    written = written.select(F.regexp_replace(convert.folders.below(F.col("path"), target), r"\.pdf$", "").alias("mark"))
    return manifest.filter("kind = 'output'").join(written, "mark", "left_anti").select("book").distinct()


def rebuild(spark: SparkSession, root: str, target: str, folder: str, options: dict | None = None, rtl: bool = False, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Convert the books below root that need it. folder: where manifests are kept. Gives what changed (book, kind, name,
    change; an output that is missing is kind output, change missing), and the report of the books that were made."""
    versions = Versions(spark, folder)
    new = kept(snapshot(spark, root, options), "manifest", work)
    changed = difference(versions.read(), new)
    missing = without_output(spark, new, target).select("book", F.lit("output").alias("kind"), F.lit("").alias("name"), F.lit("missing").alias("change"))
    changed = kept(changed.unionByName(missing), "changed", work)
    touched = changed.select("book").distinct().join(new.select("book").distinct(), "book", "left_semi")
    # the books' names go to the readers, which choose folders by them
    todo = sorted(r.book for r in touched.toLocalIterator())
    report = spark.createDataFrame([], ", ".join(c for c in convert.PAGE.split(", ") if not c.startswith("data ")))
    if todo:
        _, report = convert.convert(spark, root, target, options, rtl, work, only=todo)
    if changed.take(1):
        versions.write(new)
    return changed, report
