"""The data source of books and the PDF sink."""

import json
import re
import struct
import uuid
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from folioloom.functions import jpeg
from folioloom.operators import convert
from folioloom.sources import folders, folio, pdf
from test_sources import PIXELS, png


def with_orientation(data: bytes, turn: int, before: int = 0) -> bytes:
    """A JPEG file with an orientation, behind so many bytes of other segments."""
    tiff = b"MM" + struct.pack(">HI", 42, 8) + struct.pack(">HHHIHHI", 1, 0x0112, 3, 1, turn, 0, 0)
    body = b"Exif\0\0" + tiff
    other = b""
    while before > 0:
        n = min(before, 60_000)
        other += b"\xff\xe2" + struct.pack(">H", n + 2) + b"x" * n
        before -= n
    return data[:2] + other + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + data[2:]


def tiff(x: np.ndarray, turn: int = 1) -> bytes:
    h, w, _ = x.shape
    data = x.tobytes() + b"\0" * (x.size % 2)
    at = 8 + len(data)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 3, at + 2 + 12 * 10 + 4), (259, 3, 1, 1), (262, 3, 1, 2), (273, 4, 1, 8), (274, 3, 1, turn), (277, 3, 1, 3), (278, 4, 1, h), (279, 4, 1, x.size)]
    return b"II*\0" + struct.pack("<I", at) + data + struct.pack("<H", 10) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0) + struct.pack("<HHH", 8, 8, 8)


WIDE = np.repeat(np.arange(0, 240, 6, dtype=np.uint8)[None, :, None], 24, axis=0).repeat(3, axis=2)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    at = tmp_path_factory.mktemp("folio") / "in"
    files = {
        "top.png": png(PIXELS[3]), "b/p10.png": png(PIXELS[3]), "b/p2.PNG": png(PIXELS[1]), "b/vol 1+/a.png": png(PIXELS[4]), "out/a.png": png(PIXELS[3]), "_h/a.png": png(PIXELS[3]), "b/_x.png": png(PIXELS[3]),
        "bad/1.jpg": b"no image", "bad/2.png": png(PIXELS[3])[:40] + b"broken", "bad/3.bmp": b"", "bad/4.webp": b"RIFF\0\0\0\0WEBPVP8 ", "bad/5.heic": b"\0\0\0\x18ftypheic\0\0\0\0", "bad/6.jpg": jpeg.encode(WIDE, 90)[:30], "bad/7.png": png(PIXELS[3]), "bad/note.txt": b"",
        "turn/1.jpg": with_orientation(jpeg.encode(WIDE, 90), 6, 200_000), "turn/2.tif": tiff(PIXELS[3], 3), "turn/3.jpeg": png(PIXELS[3]),
    }
    for name, data in files.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(data)
    return str(at)


def test_every_file_has_a_row(spark, root):
    rows = {(r.book, r.file): r for r in folio.listing(spark, root, exclude="out").drop("content").collect()}
    assert {b for b, _ in rows} == {"", "b", "b/vol 1+", "bad", "turn"} and len(rows) == 14
    errors = {f: r.error for (b, f), r in rows.items() if b == "bad"}
    assert errors["1.jpg"] == "no known image format" and errors["3.bmp"] == "the file is empty" and "WebP" in errors["4.webp"] and "HEIC" in errors["5.heic"]
    assert "ends" in errors["6.jpg"] and errors["7.png"] is None and all(r.error is None for (b, _), r in rows.items() if b != "bad")
    assert rows["turn", "1.jpg"].orientation == 6 and rows["turn", "2.tif"].orientation == 3 and rows["turn", "3.jpeg"].format == "png"
    assert (rows["turn", "2.tif"].width, rows["turn", "2.tif"].height) == (5, 3) and (rows["turn", "1.jpg"].width, rows["turn", "1.jpg"].height) == (40, 24)
    assert rows["b", "p10.png"].length == Path(root, "b/p10.png").stat().st_size and rows["b", "p10.png"].modified is not None
    names_only = {(r.book, r.file): r for r in folio.listing(spark, root, exclude="out", heads=False).collect()}
    assert names_only.keys() == rows.keys() and all(r.width is None and r.error is None and r.length == rows[k].length for k, r in names_only.items())
    content = folio.listing(spark, root, content=True).filter("book = 'b' and file = 'p10.png'").first().content
    assert bytes(content) == png(PIXELS[3])


def reader(root, *filters):
    r = folio.FolioReader({"path": root})
    rest = list(r.pushFilters(list(filters)))
    return r, rest


def test_filters_choose_folders_before_files_are_opened(spark, root, monkeypatch):
    r, rest = reader(root, EqualTo(("book",), "b"), GreaterThan(("length",), 3))
    listed = []
    selector = folio.fs.FileSelector
    monkeypatch.setattr(folio.fs, "FileSelector", lambda p, **k: listed.append(p) or selector(p, **k))
    assert [(p.book, p.files) for p in r.partitions()] == [("b", ["p10.png", "p2.PNG"])] and len(rest) == 1 and listed == [f"{root}/b"]
    r, _ = reader(root, In(("book",), ("b", "turn", "none", "_h")), EqualTo(("file",), "1.jpg"))
    assert [(p.book, p.files) for p in r.partitions()] == [("turn", ["1.jpg"])]
    listed.clear()
    r, _ = reader(root, StringStartsWith(("book",), "b/vol"))
    assert [p.book for p in r.partitions()] == ["b/vol 1+"] and f"{root}/turn" not in listed
    r, _ = reader(root, EqualTo(("book",), "b"), EqualTo(("book",), "turn"))
    assert r.partitions() == []
    monkeypatch.undo()
    one = folio.listing(spark, root).filter("book = 'turn' and file > '1' and length > 0")
    assert sorted(r.file for r in one.select("file").collect()) == ["1.jpg", "2.tif", "3.jpeg"] and one.rdd.getNumPartitions() == 1
    plan = one._jdf.queryExecution().executedPlan().toString()
    above = plan.split("Filter", 1)[1].split("BatchScan")[0]  # what Spark still tests: not the book
    assert "length" in above and "book#" not in above


def test_long_folders_are_read_in_stretches(root, monkeypatch):
    monkeypatch.setattr(folio, "PER", 2)
    assert [len(p.files) for p in reader(root, EqualTo(("book",), "bad"))[0].partitions()] == [2, 2, 2, 1]
    with pytest.raises(FileNotFoundError):
        folio.FolioReader({"path": f"{root}/none"}).partitions()
    with pytest.raises(ValueError):
        folio.FolioReader({})


def raster(r):
    return np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.channels)


def test_pages_are_upright_or_say_why_not(spark, root):
    got = {(r.book, r.file): r for r in folio.pages(spark, root, exclude="out").collect()}
    assert len(got) == 14
    assert (raster(got["b", "p10.png"]) == PIXELS[3]).all() and (raster(got["b", "p2.PNG"]) == PIXELS[1]).all() and (raster(got["turn", "2.tif"]) == PIXELS[3][::-1, ::-1]).all()
    a = PIXELS[4][..., 3:].astype(int)
    assert (raster(got["b/vol 1+", "a.png"]) == (PIXELS[4][..., :3] * a + 255 * (255 - a)) // 255).all()
    turned = raster(got["turn", "1.jpg"]).astype(int)
    assert turned.shape == (40, 24, 3) and np.abs(turned - np.rot90(WIDE, -1)).mean() < 4
    bad = {f: r for (b, f), r in got.items() if b == "bad"}
    assert all(r.error and r.data is None and r.width is None for f, r in bad.items() if f != "7.png") and bad["7.png"].error is None
    assert "decoded" in bad["2.png"].error


def test_pages_of_one_book_open_its_files_only(spark, root):
    df = folio.pages(spark, root, books=["turn"])
    assert sorted(r.file for r in df.collect()) == ["1.jpg", "2.tif", "3.jpeg"]
    scans = df._jdf.queryExecution().optimizedPlan().toString()
    assert scans.count("image#") and scans.count("Relation [image") == 1
    only = spark.createDataFrame([("b", "p2.PNG"), ("bad", "1.jpg")], "book string, file string")
    assert {(r.book, r.file, r.error is None) for r in folio.pages(spark, root, only=only).collect()} == {("b", "p2.PNG", True), ("bad", "1.jpg", False)}


def test_conversion_decodes_once_and_reports_errors(spark, root, tmp_path):
    options = {"page_box": (50, 70), "deskew": False, "dewarp": False, "illumination": False, "split": "none"}
    images = folio.pages(spark, root, books=["bad"])
    cols = {"rotate": F.lit(0), "split": F.lit("none"), "split_at": F.lit(None).cast("double"), "dewarp": F.lit(False), "content": F.lit(None).cast("map<tinyint,struct<x:double,y:double,w:double,h:double>>")}
    plan = convert.process(images.withColumns(cols), options)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [image") == 1
    done, report = convert.convert(spark, root, f"file://{tmp_path}/out", options, work=str(tmp_path / "work"), only=["bad", "turn"])
    assert sorted((r.name, r.n_pages) for r in done.collect()) == [("bad", 1), ("turn", 3)]
    rows = {(r.book, r.file): r.error for r in report.collect()}
    assert len(rows) == 10 and {f for (b, f), e in rows.items() if e} == {"1.jpg", "2.png", "3.bmp", "4.webp", "5.heic", "6.jpg"}
    assert {tuple(r) for r in convert.status(report).collect()} == {("bad", 7, 1, 6), ("turn", 3, 3, 0)}


def test_a_failing_kernel_fails_its_image_only(spark, monkeypatch):
    rows = [("b", "1", 4, 4, bytearray(48), None), ("b", "2", 4, 5, bytearray(48), None), ("b", "3", None, None, None, "broken")]
    df = spark.createDataFrame(rows, "book string, file string, width int, height int, data binary, error string")
    df = df.withColumns({"rotate": F.lit(0), "split": F.lit("always"), "split_at": F.lit(None).cast("double"), "dewarp": F.lit(False), "content": F.lit(None).cast("map<tinyint,struct<x:double,y:double,w:double,h:double>>")})
    got = {r.file: r.error for r in convert.process(df, {"deskew": False, "page_box": (8, 8)}).collect()}
    assert "reshape" in got["2"] and got["3"] == "broken" and set(got) == {"1", "2", "3"}


def pdf_rows(spark, rows):
    return spark.createDataFrame(rows, "name string, page_idx int, width int, height int, channels int, data binary, dpi double")


def names(at):
    return sorted(p.relative_to(at).as_posix() for p in at.rglob("*") if p.is_file() and not p.name.startswith("."))


def test_pdf(spark, tmp_path):
    x = PIXELS[3]
    rows = [("a/one", i, 5, 3, 3, x.tobytes(), 144.0) for i in (2, 0, 1)] + [("two", 0, 5, 3, 1, PIXELS[1].tobytes(), 72.0), ("two", 1, 4, 4, 3, b"\xff\xd8\xff-jpeg", 72.0), ("none", 0, 1, 1, 1, None, 72.0)]
    for _ in range(2):  # a repeated run replaces what is there
        got = {r.name: (r.n_pages, r.n_bytes) for r in pdf.write(pdf_rows(spark, rows), f"file://{tmp_path}/out", rtl=True).collect()}
    assert names(tmp_path / "out") == ["a/one.pdf", "books.jsonl", "two.pdf"]
    one, two = ((tmp_path / "out" / f"{n}.pdf").read_bytes() for n in ("a/one", "two"))
    assert got == {"a/one": (3, len(one)), "two": (2, len(two))}
    assert b"/MediaBox [0 0 2.500 1.500]" in one and b"/Direction /R2L" in one and b"-jpeg" in two and b"/DCTDecode" in two
    stream = re.search(rb"FlateDecode /Length (\d+) >>\nstream\n", one)
    assert zlib.decompress(one[stream.end() : stream.end() + int(stream[1])]) == x.tobytes()
    for f in (one, two):  # every offset of the table leads to its object
        at = int(re.search(rb"startxref\n(\d+)", f)[1])
        for i, line in enumerate(f[at:].split(b"\n")[3:]):
            if not line.endswith(b" n "):
                break
            assert f[int(line[:10]) :].startswith(b"%d 0 obj" % (i + 1))


def test_a_failed_job_leaves_no_book(spark, tmp_path):
    good = [("one", 0, 5, 3, 1, PIXELS[1].tobytes(), 72.0), ("three", 0, 5, 3, 1, PIXELS[1].tobytes(), 72.0)]
    target = f"file://{tmp_path}/out"
    pdf.write(pdf_rows(spark, good), target)
    before = {n: (tmp_path / "out" / n).read_bytes() for n in names(tmp_path / "out")}
    bad = good[:1] + [("two", 1, 5, 3, 1, PIXELS[1].tobytes(), 72.0), ("two", 1, 5, 3, 1, PIXELS[1].tobytes(), 72.0)]
    with pytest.raises(Exception, match="comes after"):
        pdf.write(pdf_rows(spark, bad + [("one", 1, 5, 3, 1, PIXELS[1].tobytes(), 72.0)]), target)
    assert {n: (tmp_path / "out" / n).read_bytes() for n in names(tmp_path / "out")} == before
    assert [p.name for p in (tmp_path / "out").iterdir() if p.is_dir()] == []
    # pages of one book in two tasks, written without write()
    spread = pdf_rows(spark, [("s", i, 5, 3, 1, PIXELS[1].tobytes(), 72.0) for i in range(2)]).repartition(2, "page_idx")
    if spread.groupBy(F.spark_partition_id()).count().count() == 2:
        with pytest.raises(Exception, match="same book"):
            spread.write.format("folio_pdf").mode("append").save(target)
        assert not (tmp_path / "out" / "s.pdf").exists()


def test_broken_off_commits_are_finished(tmp_path):
    target, out = f"file://{tmp_path}/out", tmp_path / "out"
    writer = pdf.PdfWriter(target, False)
    batch = pa.RecordBatch.from_pylist([{"name": n, "page_idx": 0, "width": 5, "height": 3, "channels": 1, "data": PIXELS[1].tobytes(), "dpi": 72.0} for n in ("a", "b")])
    done = writer.write(iter([batch]))
    again = writer.write(iter([batch]))  # a repeated task, whose files nobody takes
    assert names(out) and not (out / "a.pdf").exists()
    journal = {"staging": f"{out}/{pdf.STAGING}{writer.job}", "books": done.books}
    (out / f"{pdf.JOURNAL}{writer.job}.json").write_text(json.dumps(journal))
    Path(done.books[0][1]).rename(out / "a.pdf")  # the driver died after one move
    assert pdf.recover(target) == 1 and names(out) == ["a.pdf", "b.pdf", "books.jsonl"] and pdf.recover(target) == 0
    assert again.books[0][1] != done.books[0][1] and not list(out.glob("_staging*"))
    other = pdf.PdfWriter(target, False)
    other.write(iter([batch]))
    other.abort([None])
    assert names(out) == ["a.pdf", "b.pdf", "books.jsonl"]
    assert uuid.UUID(other.job)
