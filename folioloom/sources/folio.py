"""Books as a data source: spark.read.format("folio").load(root) gives one row an image file, whatever its state.

register(spark) makes the format known and lets filters reach it. A folder is a book; partitions are folders (long ones in
stretches of PER files), so a task opens the files of one book only. Filters on book and file are taken over before anything
is opened: an equal or IN filter on book lists those folders alone, a prefix filter leaves out the others, and files that a
filter on file excludes are never read.

Each row says what the file's head tells: the format by content (never by name), width and height as stored, the orientation
to be undone, and in error why it gives no page, else null. option("content", "true") adds the bytes. Formats without a
decoder in Spark (WebP, HEIC) have an error, as have empty files, unknown contents, heads that end early, and files that can't
be opened. option("heads", "false") opens no file: names, lengths and times only. A broken body is only seen when the raster is decoded: see pages().

pages() decodes the good files in the JVM and puts them upright. Rows with errors go along without a raster, so that every
listed file is accounted for. Hidden folders and files (leading "_" or "."), and those below exclude, are neither listed nor
opened. A root without images gives no row; a root that is missing is an error.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from folioloom.functions.scalars import EXTENSIONS

from . import folders

SCHEMA = "path string, book string, file string, length long, modified timestamp, format string, width int, height int, orientation int, error string, content binary"
#: Files in a partition; bytes of content in a batch; bytes that are read of a head at once.
PER, BATCH, STEP = 256, 32 << 20, 1 << 16
DECODED = ("jpeg", "png", "bmp", "gif", "tiff")


class Head(ValueError):
    """Why a file gives no page."""


def _exact(f, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Head("the file ends within its head")
    return data


def _exif(tiff: bytes) -> int:
    """The orientation in a block of TIFF tags; 1 for none."""
    order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
    if order is None:
        return 1
    at = int.from_bytes(tiff[4:8], order)
    for k in range(int.from_bytes(tiff[at : at + 2], order)):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if int.from_bytes(entry[:2], order) == 0x0112:
            value = int.from_bytes(entry[8:10], order)
            return value if 1 <= value <= 8 else 1
    return 1


def _jpeg(f) -> tuple[int, int, int]:
    """Segment after segment, up to the frame's header and the start of the scan, wherever these are."""
    size, turn = None, 1
    while True:
        mark = _exact(f, 1)
        if mark != b"\xff":
            raise Head("no JPEG segment where one should be")
        while mark == b"\xff":
            mark = _exact(f, 1)
        kind = mark[0]
        if kind == 0xD9 or kind == 0xDA:
            break
        if kind == 0x01 or 0xD0 <= kind <= 0xD8:
            continue
        n = int.from_bytes(_exact(f, 2), "big") - 2
        if n < 0:
            raise Head("a JPEG segment of no length")
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            body = _exact(f, n)
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
        elif kind == 0xE1:
            body = _exact(f, n)
            if body[:6] == b"Exif\0\0":
                turn = _exif(body[6:])
        else:
            f.seek(n, io.SEEK_CUR)
    if not size:
        raise Head("no frame in the JPEG file")
    return *size, turn


def _png(f) -> tuple[int, int, int]:
    head = _exact(f, 25)
    if head[4:8] != b"IHDR":
        raise Head("no header in the PNG file")
    size, turn = (int.from_bytes(head[8:12], "big"), int.from_bytes(head[12:16], "big")), 1
    while len(chunk := f.read(8)) == 8 and chunk[4:] not in (b"IDAT", b"IEND"):
        n = int.from_bytes(chunk[:4], "big")
        if chunk[4:] == b"eXIf":
            turn = _exif(f.read(n))
            f.seek(4, io.SEEK_CUR)
        else:
            f.seek(n + 4, io.SEEK_CUR)
    return *size, turn


def _tiff(f, order: str) -> tuple[int, int, int]:
    at = int.from_bytes(_exact(f, 4), order)
    f.seek(at)
    tags = {}
    for _ in range(int.from_bytes(_exact(f, 2), order)):
        entry = _exact(f, 12)
        wide = int.from_bytes(entry[2:4], order) == 4
        tags[int.from_bytes(entry[:2], order)] = int.from_bytes(entry[8 : 12 if wide else 10], order)
    turn = tags.get(274, 1)
    return tags.get(256, 0), tags.get(257, 0), turn if 1 <= turn <= 8 else 1


def head(f) -> tuple[str, int, int, int]:
    """format, width, height and orientation of an open file, by its content."""
    start = f.read(16)
    f.seek(2)
    if not start:
        raise Head("the file is empty")
    if start[:3] == b"\xff\xd8\xff":
        found = "jpeg", *_jpeg(f)
    elif start[:8] == b"\x89PNG\r\n\x1a\n":
        f.seek(8)
        found = "png", *_png(f)
    elif start[:6] in (b"GIF87a", b"GIF89a"):
        f.seek(6)
        size = _exact(f, 4)
        found = "gif", int.from_bytes(size[:2], "little"), int.from_bytes(size[2:], "little"), 1
    elif start[:2] == b"BM":
        f.seek(18)
        size = _exact(f, 8)
        found = "bmp", int.from_bytes(size[:4], "little", signed=True), abs(int.from_bytes(size[4:], "little", signed=True)), 1
    elif start[:4] in (b"II*\0", b"MM\0*"):
        f.seek(4)
        found = "tiff", *_tiff(f, "little" if start[:2] == b"II" else "big")
    elif start[:4] == b"RIFF" and start[8:12] == b"WEBP":
        raise Head("no decoder for WebP")
    elif start[4:8] == b"ftyp":
        raise Head("no decoder for HEIC")
    else:
        raise Head("no known image format")
    if found[1] <= 0 or found[2] <= 0:
        raise Head("an image of no size")
    return found


class Folder(InputPartition):
    """A stretch of the files of one book."""

    def __init__(self, book: str, files: list[str]):
        self.book, self.files = book, files


def _hidden(name: str) -> bool:
    return name[:1] in ("_", ".")


def _supported(name: str) -> bool:
    stem, dot, kind = name.rpartition(".")
    return bool(stem and dot) and not _hidden(name) and kind.lower() in EXTENSIONS


class FolioReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("load() needs the root folder of the books")
        self.heads = options.get("heads", "true").lower() == "true"
        self.content = options.get("content", "false").lower() == "true"
        self.exclude = options.get("exclude")
        #: Of how many parts of all paths (by crc32) which one is wanted.
        self.part, self.parts = (int(options.get(k, d)) for k, d in (("part", "0"), ("parts", "1")))
        #: What filters have left: names that a book and a file must be among, and prefixes that they must have.
        self.among: dict[str, set[str] | None] = {"book": None, "file": None}
        self.prefix: dict[str, list[str]] = {"book": [], "file": []}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over equal, IN and prefix filters on book and file; give the others back."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name not in self.among:
                yield f
            elif isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.among[name] = values if self.among[name] is None else self.among[name] & values
            elif isinstance(f, StringStartsWith):
                self.prefix[name].append(f.value)
            elif isinstance(f, IsNotNull):
                pass  # they never are
            else:
                yield f

    def _wanted(self, column: str, value: str) -> bool:
        among = self.among[column]
        return (among is None or value in among) and all(value.startswith(p) for p in self.prefix[column])

    def _store(self) -> tuple[fs.FileSystem, str]:
        return (fs.FileSystem.from_uri(self.root) if ":/" in self.root else (fs.LocalFileSystem(), self.root.rstrip("/")))

    def _visible(self, book: str) -> bool:
        out = self.exclude
        return not any(_hidden(x) for x in book.split("/") if book) and not (out is not None and (book == out or book.startswith(f"{out}/")))

    def partitions(self) -> list[Folder]:
        """Folders with the names of their files; only folders that filters leave are listed, where these name them."""
        store, base = self._store()
        if store.get_file_info(base).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder at {self.root}")
        named, todo, out = self.among["book"], [""], []
        if named is not None:
            todo = sorted(b for b in named if b is not None and self._visible(b) and store.get_file_info(f"{base}/{b}").type == fs.FileType.Directory)
        while todo:
            book = todo.pop()
            files = []
            for info in store.get_file_info(fs.FileSelector(f"{base}/{book}" if book else base)):
                if info.type == fs.FileType.Directory:
                    below = f"{book}/{info.base_name}" if book else info.base_name
                    if named is None and self._visible(below) and self._leads(below):
                        todo.append(below)
                elif info.is_file and _supported(info.base_name) and self._wanted("file", info.base_name) and self._dealt(book, info.base_name):
                    files.append(info.base_name)
            if self._wanted("book", book):
                files.sort()
                out += [Folder(book, files[lo : lo + PER]) for lo in range(0, len(files), PER)]
        return out

    def _dealt(self, book: str, name: str) -> bool:
        return self.parts < 2 or zlib.crc32((f"{book}/{name}" if book else name).encode()) % self.parts == self.part

    def _leads(self, folder: str) -> bool:
        """Whether a folder, or one below it, may have the prefixes that books must have."""
        return all(f"{folder}/".startswith(p) or p.startswith(f"{folder}/") or folder.startswith(p) for p in self.prefix["book"])

    def read(self, part: Folder | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark's only partition, where there are none
            return
        store, base = self._store()
        schema = pa.schema([("path", pa.string()), ("book", pa.string()), ("file", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", tz="UTC")), ("format", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("orientation", pa.int32()), ("error", pa.string()), ("content", pa.binary())])
        scheme = self.root.split(":", 1)[0] + "://" if "://" in self.root else "file://"
        rows, held = [], 0
        for name in part.files:
            path = f"{base}/{part.book}/{name}" if part.book else f"{base}/{name}"
            row = {"path": f"{scheme}{path}", "book": part.book, "file": name}
            try:
                info = store.get_file_info(path)
                row |= {"length": info.size, "modified": info.mtime}
                if not self.heads:
                    rows.append(row)
                    continue
                with store.open_input_file(path) as f:
                    row |= dict(zip(("format", "width", "height", "orientation"), head(f)))
                    if self.content:
                        f.seek(0)
                        row["content"] = f.read()
            except (Head, OSError) as e:
                row["error"] = str(e)
            rows.append(row)
            held += len(row.get("content", b""))
            if held >= BATCH:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


class Folio(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folio"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolioReader:
        return FolioReader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Folio)


def listing(spark: SparkSession, root: str, exclude: str | None = None, content: bool = False, heads: bool = True, part: tuple[int, int] = (0, 1)) -> DataFrame:
    register(spark)
    read = spark.read.format("folio").option("content", str(content).lower()).option("heads", str(heads).lower()).option("part", str(part[0])).option("parts", str(part[1]))
    return (read if exclude is None else read.option("exclude", exclude)).load(root)


def pages(spark: SparkSession, root: str, exclude: str | None = None, only: DataFrame | None = None, books: list[str] | None = None, part: tuple[int, int] = (0, 1)) -> DataFrame:
    """path, book, file, width, height, channels (3), data (RGB rows) and error of every image: put upright, or why not.

    books: those folders alone; neither the listing nor the decoder opens a file of another one. only: rows (book, file) that
    are wanted. part: one of so many shares of all paths, the others are not opened either. The list of files is read once, and is the small side of a join with what the JVM decodes.
    """
    found = listing(spark, root, exclude, part=part)
    if books is not None:
        found = found.filter(F.col("book").isin(books))
    if only is not None:
        found = found.join(only.select("book", "file").distinct(), ["book", "file"], "left_semi")
    found = found.select("path", "book", "file", "orientation", "error", folders.below(F.col("path"), root).alias("rel"))
    return folders.upright(spark, root, found, books, part)
