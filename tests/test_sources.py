"""Folders, decoding, the PDF sink and streaming ingestion on small folders made here."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.sources import folders
from folioloom.streaming import ingest


def png(x: np.ndarray) -> bytes:
    kind = {1: 0, 3: 2, 4: 6}[x.shape[2]]
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    rows = b"".join(b"\0" + r.tobytes() for r in x)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", x.shape[1], x.shape[0], 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(3)
PIXELS = {c: RNG.integers(0, 256, (3, 5, c), dtype=np.uint8) for c in (1, 3, 4)}


@pytest.fixture
def root(tmp_path):
    at = tmp_path / "in"
    for name, c in {"b/p10.png": 3, "b/p2.PNG": 1, "b/vol 1+/a.png": 4, "top.png": 3, "b/_x.png": 3, "_h/a.png": 3, "out/a.png": 3}.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_bytes(png(PIXELS[c]))
    (at / "b/note.txt").write_text("no image")
    (at / "b/broken.jpg").write_bytes(b"no image")
    return str(at)


def test_listing(spark, root):
    found = folders.images(spark, root, exclude="out")
    names = [(r.book, r.file) for r in folders.ordered(found).collect()]
    assert names == [("", "top.png"), ("b", "broken.jpg"), ("b", "p2.PNG"), ("b", "p10.png"), ("b/vol 1+", "a.png")]
    assert {(r.book, r.n_images) for r in folders.books(found).collect()} == {("", 1), ("b", 3), ("b/vol 1+", 1)}


def test_turned():
    x = np.arange(6).reshape(2, 3, 1)
    assert folders.turned(x, 6)[..., 0].tolist() == np.rot90(x, -1)[..., 0].tolist()
    assert folders.turned(x, 8)[..., 0].tolist() == np.rot90(x)[..., 0].tolist()
    assert folders.turned(x, 3)[..., 0].tolist() == x[::-1, ::-1, 0].tolist()
    assert folders.turned(x, 5)[..., 0].tolist() == x[..., 0].T.tolist()


def test_ingest(spark, root, tmp_path):
    batches = []
    run = lambda: ingest.follow(ingest.arrivals(spark, root, exclude="out"), lambda b, n: batches.append({r.book for r in b.collect()}), str(tmp_path / "cp")).awaitTermination(120)
    run()
    assert batches == [{"", "b", "b/vol 1+"}]
    (tmp_path / "in/b/p11.png").write_bytes(png(PIXELS[3]))
    run()
    run()
    assert batches[1:] == [{"b"}]


def test_empty_book_list(spark):
    none = spark.createDataFrame([], "path string, book string, file string, length long, modified timestamp")
    assert folders.books(none).filter(F.col("n_images") > 0).count() == 0
