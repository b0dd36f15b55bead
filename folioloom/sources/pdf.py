"""A sink that writes one PDF a book.

Pages are dealt by book and sorted within the task, and stream to the file one by one: a task holds one page, whatever the
book's length. JPEG data pass as they are; other rasters are stored losslessly. Tasks write below a staging folder, and
the job's commit puts all books in place: a job that fails leaves none, and repeated or speculative tasks do no harm. The
books of the last commit are listed in the target folder (BOOKS, a JSON line each).
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING, JOURNAL, BOOKS = "_staging-", "_commit-", "books.jsonl"
COLUMNS = ("name", "page_idx", "width", "height", "channels", "data", "dpi")


class Book:
    """A PDF under construction on a stream of bytes."""

    def __init__(self, out, rtl: bool = False):
        self.out, self.rtl, self.size, self.offsets, self.kids = out, rtl, 0, {}, []
        self._put(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def _object(self, number: int, head: str, stream: bytes | None = None) -> None:
        self.offsets[number] = self.size
        body = head.encode() if stream is None else head.encode() + b"\nstream\n" + stream + b"\nendstream"
        self._put(b"%d 0 obj\n" % number + body + b"\nendobj\n")

    def page(self, width: int, height: int, channels: int, data: bytes, dpi: float) -> None:
        n = 3 + 3 * len(self.kids)
        w, h = (f"{px * 72 / dpi:.3f}" for px in (width, height))
        content = f"q {w} 0 0 {h} 0 0 cm /Im0 Do Q".encode()
        kind = "DCTDecode" if data[:3] == b"\xff\xd8\xff" else "FlateDecode"
        data = data if kind == "DCTDecode" else zlib.compress(data)
        space = "DeviceGray" if channels == 1 else "DeviceRGB"
        self._object(n, f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w} {h}] /Resources << /XObject << /Im0 {n + 2} 0 R >> >> /Contents {n + 1} 0 R >>")
        self._object(n + 1, f"<< /Length {len(content)} >>", content)
        image = f"<< /Type /XObject /Subtype /Image /Width {width} /Height {height} /ColorSpace /{space} /BitsPerComponent 8 /Filter /{kind} /Length {len(data)} >>"
        self._object(n + 2, image, data)
        self.kids.append(n)

    def finish(self) -> None:
        rtl = " /ViewerPreferences << /Direction /R2L >>" if self.rtl else ""
        self._object(1, f"<< /Type /Catalog /Pages 2 0 R /PageLayout /TwoPageRight{rtl} >>")
        self._object(2, f"<< /Type /Pages /Count {len(self.kids)} /Kids [{' '.join(f'{k} 0 R' for k in self.kids)}] >>")
        at, n = self.size, len(self.offsets) + 1
        self._put(f"xref\n0 {n}\n0000000000 65535 f \n".encode() + b"".join(b"%010d 00000 n \n" % self.offsets[i] for i in range(1, n)))
        self._put(f"trailer\n<< /Size {n} /Root 1 0 R >>\nstartxref\n{at}\n%%EOF\n".encode())


class Committed(WriterCommitMessage):
    """The books of one task: name, where the file waits, pages and bytes."""

    def __init__(self, books: list[tuple[str, str, int, int]]):
        self.books = books


class PdfWriter(DataSourceArrowWriter):
    """Writes one file a book below a staging folder of the job; only a commit moves them to their places.

    A commit first writes a journal of the moves, then carries them out, then removes journal and staging folder. A later
    commit, or recover(), finishes the moves of a journal that was left behind; a job that fails before its commit leaves no
    book, and what it staged is removed by abort (or, if the driver died, by the next commit of the same job's target).
    """

    def __init__(self, target: str, rtl: bool):
        self.target, self.rtl, self.job = target, rtl, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Committed:
        store, base = fs.FileSystem.from_uri(self.target)
        folder = f"{base}/{STAGING}{self.job}/{uuid.uuid4().hex}"
        done, seen, book, name, last = [], set(), None, None, None

        def close() -> None:
            book.finish()
            book.out.close()
            done.append((name, path, len(book.kids), book.size))

        for b in iterator:
            for row in (b.slice(i, 1) for i in range(b.num_rows)):
                this, place, width, height, channels, data, dpi = (row[c][0].as_py() for c in COLUMNS)
                if this is None or data is None:
                    continue
                if this != name:
                    if book:
                        close()
                    if this in seen:
                        raise ValueError(f"the pages of {this!r} don't stand together")
                    seen.add(this)
                    name, last, path = this, None, f"{folder}/{this}.pdf"
                    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                    book = Book(store.open_output_stream(path), self.rtl)
                if last is not None and place <= last:
                    raise ValueError(f"page {place} of {this!r} comes after page {last}")
                last = place
                book.page(width, height, channels, data, dpi)
        if book:
            close()
        return Committed(done)

    def commit(self, messages: list[Committed | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.target)
        books = [x for m in messages if m for x in m.books]
        names = [x[0] for x in books]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"several tasks wrote the same book: {sorted({n for n in names if names.count(n) > 1})[:3]}")
        store.create_dir(base, recursive=True)
        recover(self.target)
        journal = f"{base}/{JOURNAL}{self.job}.json"
        with store.open_output_stream(f"{journal}.part") as out:
            out.write(json.dumps({"staging": f"{base}/{STAGING}{self.job}", "books": books}).encode())
        store.move(f"{journal}.part", journal)
        _finish(store, base, journal)

    def abort(self, messages: list[Committed | None]) -> None:
        store, base = fs.FileSystem.from_uri(self.target)
        staging = f"{base}/{STAGING}{self.job}"
        if store.get_file_info(staging).type == fs.FileType.Directory:
            store.delete_dir(staging)


def _finish(store: fs.FileSystem, base: str, journal: str) -> None:
    """Carry out the moves of a journal, some of which may be done already, and list the books that it wrote."""
    with store.open_input_stream(journal) as f:
        plan = json.loads(f.read())
    for name, path, _, _ in plan["books"]:
        if store.get_file_info(path).type == fs.FileType.File:
            store.create_dir(f"{base}/{name}.pdf".rsplit("/", 1)[0], recursive=True)
            store.move(path, f"{base}/{name}.pdf")
    lines = "".join(json.dumps({"name": n, "n_pages": p, "n_bytes": b}) + "\n" for n, _, p, b in plan["books"])
    with store.open_output_stream(f"{base}/{BOOKS}") as out:
        out.write(lines.encode())
    if store.get_file_info(plan["staging"]).type == fs.FileType.Directory:
        store.delete_dir(plan["staging"])
    store.delete_file(journal)


def recover(target: str) -> int:
    """Finish the commits that were broken off below target; the number of them."""
    store, base = fs.FileSystem.from_uri(target)
    left = sorted(i.path for i in store.get_file_info(fs.FileSelector(base, allow_not_found=True)) if i.base_name.startswith(JOURNAL) and i.base_name.endswith(".json"))
    for journal in left:
        _finish(store, base, journal)
    return len(left)


class FolioPdf(DataSource):
    """The format "folio_pdf": pages (COLUMNS, a book's pages together and in order) into path, a file for each name."""

    @classmethod
    def name(cls) -> str:
        return "folio_pdf"

    def schema(self) -> str:
        return "name string, page_idx int, width int, height int, channels int, data binary, dpi double"

    def writer(self, schema, overwrite: bool) -> PdfWriter:
        lacking = [c for c in COLUMNS if c not in schema.fieldNames()]
        if lacking or not self.options.get("path"):
            raise ValueError(f"pages need {', '.join(lacking)}" if lacking else "save() needs the target folder")
        return PdfWriter(self.options["path"], self.options.get("rtl", "false").lower() == "true")


def write(pages: DataFrame, target: str, rtl: bool = False) -> DataFrame:
    """Write target/<name>.pdf for each name, all or none; pages has name (unique paths below target), page_idx (no two equal
    in a book), width, height, channels, data and dpi. Gives the books written: name, n_pages, n_bytes. Rows without data or
    name are left out. A repeated call replaces the files."""
    spark = pages.sparkSession
    spark.dataSource.register(FolioPdf)
    rows = pages.filter(F.col("data").isNotNull() & F.col("name").isNotNull()).repartition("name").sortWithinPartitions("name", "page_idx")
    rows = rows.select("name", F.col("page_idx").cast("int").alias("page_idx"), "width", "height", "channels", "data", F.col("dpi").cast("double").alias("dpi"))
    rows.write.format("folio_pdf").option("rtl", str(rtl).lower()).mode("append").save(target)
    return spark.read.schema("name string, n_pages long, n_bytes long").json(f"{target}/{BOOKS}")
