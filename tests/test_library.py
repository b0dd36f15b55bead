"""Listings, uploads, thumbnails and grids."""

import base64

import numpy as np
from pyspark.sql import functions as F

from folioloom.functions import grids
from folioloom.operators import library


def grid(gh, gw, f):
    t, s = np.mgrid[0:gh, 0:gw]
    return np.stack(f(s / (gw - 1), t / (gh - 1))).astype(np.float32)


def test_identity_grid_gives_the_page_back():
    img = np.random.default_rng(1).integers(0, 256, (30, 40, 3), dtype=np.uint8)
    same = grid(4, 5, lambda s, t: (2 * s - 1, 2 * t - 1))
    assert np.abs(grids.remap(img, same).astype(int) - img).max() <= 1
    assert (grids.remap(img, same + 3) == 255).all()


def test_projection_keeps_perspective_and_drops_bends():
    tilted = grid(45, 31, lambda s, t: ((1.6 * s - 0.8) / (1 + 0.2 * s), (1.5 * t - 0.7 + 0.1 * s) / (1 + 0.2 * s)))
    assert np.abs(grids.without_curl(tilted) - tilted).max() < 1e-4
    inner = grid(45, 31, lambda s, t: (0 * s, 0.08 * np.sin(np.pi * s) * np.sin(np.pi * t)))
    assert np.abs(grids.without_curl(tilted + inner) - tilted).max() < 1e-4
    assert grids.homography(np.zeros((4, 2)), np.zeros((4, 2))) is None


def test_cut_follows_a_slanted_gutter():
    slanted = grid(5, 5, lambda s, t: (2 * s - 1 + 0.1 - 0.2 * t, 2 * t - 1))
    left, right = grids.gutter_cut(1001, slanted, 500)
    assert abs(left - 560) <= 2 and abs(right - 440) <= 2


def test_listings(spark):
    books = lambda rows: spark.createDataFrame(rows, "book string, n int, modified int")
    both = library.over_roots([books([("b2", 1, 1), ("b10", 2, 5)]), books([("b10", 9, 9), ("a", 3, 2)])])
    assert [(r.book, r.n, r.root) for r in both.collect()] == [("b2", 1, 0), ("b10", 2, 0), ("a", 3, 1)]
    done = books([("b10", 0, 0)])
    assert [(r.book, r.pdf) for r in library.newest_first(books([("b2", 1, 1), ("b10", 2, 5), ("_x", 1, 9)]), done).collect()] == [("b10", True), ("b2", False)]
    assert [r.book for r in library.without_done(both, done, "book").orderBy("book").collect()] == ["a", "b2"] and library.without_done(both, done, "book", skip=False).count() == 3
    assert sorted(r.book for r in library.added(done, books([("b10", 1, 1), ("c", 1, 1), ("c", 2, 2)]), "book").collect()) == ["b10", "c"]
    info = library.folder_info(spark.createDataFrame([("b", "10.jpg"), ("b", "2.jpg")], "book string, file string"), spark.createDataFrame([("b", "2.jpg", True)], "book string, file string, skip boolean"))
    assert [(r.file, r.skip) for r in info.collect()] == [("2.jpg", True), ("10.jpg", None)]


def test_uploads_and_counts(spark):
    files = lambda rows: spark.createDataFrame(rows, "book string, file string, sent int")
    named = library.upload_names(files([("b", "x.JPG", 2), ("b", "y.png", 1), ("b", "z.txt", 3), ("c", "q.webp", 1)]), files([("b", "0007.jpg", 0)]), ["sent"])
    assert {r.file: r.stored for r in named.collect()} == {"y.png": "0008.png", "x.JPG": "0009.jpg", "q.webp": "0001.webp"}
    got = library.counts(named, ["book"], F.col("file").endswith("png")).collect()
    assert {(r.book, r.n, r.failed) for r in got} == {("b", 2, 1), ("c", 1, 0)}
    assert library.box_for(3508) == {"page_box": (2480, 3508), "dpi": 300.0}


def test_thumbnails_and_summary(spark, tmp_path):
    img = np.full((60, 40, 3), (200, 30, 90), dtype=np.uint8)
    df = spark.createDataFrame([("p", 40, 60, bytearray(img.tobytes()))], "path string, width int, height int, data binary")
    url = library.thumbnails(df, 30).first().url
    (tmp_path / "t.jpg").write_bytes(base64.b64decode(url.split(",")[1]))
    row = spark.read.format("image").load(f"{tmp_path}/t.jpg").select("image.*").first()
    assert (row.width, row.height) == (20, 30) and url.startswith("data:image/jpeg;base64,")
    report = spark.createDataFrame([("b", "1", None, True, 1.25, True, 12.3, None), ("b", "2", None, False, 0.01, False, None, None), ("b", "3", None, None, None, None, None, "no image")], "book string, file string, half int, deskewed boolean, angle double, straightened boolean, bend double, error string")
    assert [r.line for r in library.summary(report).orderBy("file").collect()] == ["skew +1.25, bend 12.3 px", "skew -, bend -", "error: no image"]
