"""Rasters, overrides and whole books: pages drawn here, turned, shaded, split and put together again."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.functions import jpeg, rasters
from folioloom.functions import lines as straight
from folioloom.operators import books, convert
from folioloom.sources import overrides
from test_sources import png


def lines(img, x0, x1, n=30):
    for i in range(n):
        for x in range(x0, x1, 22):
            img[150 + 36 * i : 170 + 36 * i, x : min(x + 16, x1)] = 20
    return img


def paper(w, h, value=250):
    return np.full((h, w, 3), value, dtype=np.uint8)


@pytest.mark.parametrize("angle", [2.0, -1.5])
def test_rotation_is_found_and_undone(angle):
    page = rasters.rotate(lines(paper(1000, 1400), 120, 880), angle)
    out, found, applied = rasters.deskew(page)
    assert applied and abs(found - angle) < 0.1 and abs(rasters.skew(out)) < 0.1
    assert rasters.deskew(paper(800, 1100))[1:] == (None, False)


def test_gutter_between_two_pages():
    img = lines(lines(paper(2000, 1400), 120, 900), 1180, 1880)
    shade = 1 - 0.5 * np.exp(-(((np.arange(2000) - 1040) / 30.0) ** 2))
    img = (img * shade[None, :, None]).astype(np.uint8)
    assert abs(rasters.gutter(img) - 1040) < 30
    assert convert.halves(paper(1000, 1400), "auto", None, convert.OPTIONS)[1] is None
    parts, x = convert.halves(img, "at", 0.48, convert.OPTIONS)
    assert x == 960 and [p.shape[1] for p in parts] == [960, 1040]


def test_light_is_evened_and_text_stays():
    img = np.repeat((120 + 120 * np.arange(600) / 600).astype(np.uint8)[None, :, None], 800, axis=0).repeat(3, axis=2)
    img[300:320, 100:116] = 20
    out = rasters.even_light(img)
    assert out[50, 50].min() > 240 and out[700, 550].min() > 240 and out[310, 108].max() < 80
    yellow = np.full((600, 400, 3), (240, 225, 190), dtype=np.uint8)
    assert (rasters.even_light(yellow)[300, 200] == 255).all()


def test_content_without_border_shadow():
    img = paper(1000, 1400)
    y, x = np.mgrid[200:1100, 150:800]
    img[200:1100, 150:800][((x // 10 + y // 10) % 2) == 0] = 20
    img[:, :8] = 30
    assert np.abs(np.array(rasters.content_box(img)) - (150, 200, 650, 900)).max() <= 4
    assert rasters.content_box(paper(800, 1100)) is None


def test_components_against_flood_fill():
    mask = np.random.default_rng(4).random((40, 60)) < 0.35
    seen, want = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            todo, cells = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for c in range(max(a - 1, 0), min(a + 2, 40)):
                    for d in range(max(b - 1, 0), min(b + 2, 60)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
            (y0, x0), (y1, x1) = np.min(cells, axis=0), np.max(cells, axis=0)
            want.append((x0, y0, x1 - x0 + 1, y1 - y0 + 1, len(cells)))
    assert sorted(map(tuple, rasters.components(mask).tolist())) == sorted(want)
    assert len(rasters.components(np.zeros((5, 5), dtype=bool))) == 0


def test_curves_recover_a_quadratic():
    u = np.arange(50) / 25 - 1
    c, few, cubic = straight.fit_all([(25 + 25 * u, 3 + 2 * u - 0.5 * u * u), (np.arange(5.0), np.arange(5.0)), (25 + 25 * u[:30], u[:30] ** 3)], [2, 4, 3], 25.0, 1.0)
    assert np.allclose(c.poly, [3, 2, -0.5], atol=1e-9) and few is None and np.allclose(cubic.poly, [0, 0, 0, 1], atol=1e-9) and (cubic.x0, cubic.x1) == (0.0, 29.0)
    assert straight.fit_all([], [], 25.0, 1.0) == []
    y = 3 + 2 * u - 0.5 * u * u
    y[::7] += 90
    odd, still = straight.fit_all([(25 + 25 * u, y), (25 + 25 * u, 0 * u)], [2, 2], 25.0, 1.0, 2.0)
    assert np.allclose(odd.poly, [3, 2, -0.5], atol=1e-9) and odd.x0 == 1.0 and np.allclose(still.line, 0)
    wild = np.random.default_rng(1).uniform(-50, 50, 50)
    assert straight.fit_all([(25 + 25 * u, wild)], [2], 25.0, 1.0, 2.0) == [None]


def test_bent_lines_become_straight():
    flat = lines(paper(1000, 1400), 100, 900)
    bend = lambda x, y: (x, y - 14 * np.clip(1 - x / 350, 0, 1) ** 2)
    bent = rasters.warp(flat, 1000, 1400, bend, True)
    out, applied, most = straight.straighten(bent)
    assert applied and 5 < most < 40 and out.shape[0] == 1400 and out.shape[1] >= 1000

    def spread(img):  # of the rows of ink near the left end against those further right
        rows = lambda a, b: np.flatnonzero((img[140:185, a:b, 0] < 100).any(axis=1)).mean()
        return abs(rows(105, 180) - rows(500, 800))

    assert spread(bent) >= 5 and spread(out) <= 1.5
    assert straight.straighten(paper(800, 1100))[1] is False and straight.straighten(flat)[1] is False


def test_closing_and_bilinear_grid():
    row = np.zeros((1, 10), dtype=bool)
    row[0, [2, 5]] = True
    closed = rasters.close_across(row, 4)[0]
    assert closed[2:6].all() and not closed[0] and not closed[8]
    grid = np.array([[0.0, 1.0], [2.0, 3.0]])
    assert np.allclose(straight.bilinear(grid, np.array([0.5, -1.0, 9.0]), np.array([0.5, 0.0, 9.0])), [1.5, 0.0, 3.0])


def test_crop_and_fill():
    img = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    out = rasters.crop(img, -1, 2, 3, 4)
    assert (out[:2, 1:] == img[2:, :2]).all() and (out[2:] == 255).all() and (out[:, 0] == 255).all()
    assert (rasters.crop(img, 9, 9, 2, 2) == 255).all()
    page = np.zeros((40, 40, 3), dtype=np.uint8)
    filled = rasters.fill_outside(page, (10, 12, 8, 6))
    assert (filled[8:22, 6:22] == 0).all() and (filled[:8] == 255).all() and (filled[:, 22:] == 255).all()


def test_jpeg_round_trip(spark, tmp_path):
    y, x = np.mgrid[0:61, 0:83]
    colour = np.stack(((x * 3) % 256, (y * 4) % 256, (x + y) % 256), axis=2).astype(np.uint8)
    for name, img, channels in (("c", colour, 3), ("g", colour[..., 2], 1), ("flat", np.full((40, 40), 200, dtype=np.uint8), 1)):
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.encode(img, 92))
        row = spark.read.format("image").load(f"{tmp_path}/{name}.jpg").select("image.*").first()
        got = np.frombuffer(row.data, dtype=np.uint8).reshape(row.height, row.width, row.nChannels)[..., ::-1].astype(int)
        assert row.nChannels == channels and np.abs(got.reshape(img.shape) - img).mean() < 3


def test_overrides_round_trip(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "overrides.json").write_text('{"pages":{"1.jpg":{"rotate":90,"split":{"at":0.48},"content":{"1":{"x":0.1,"y":0.1,"w":0.8,"h":0.8}}},"2 \\"x\\".jpg":{"skip":true,"split":"none"}}}')
    found = overrides.load(spark, str(tmp_path))
    rows = {r.file: r for r in found.collect()}
    assert rows["1.jpg"].split_at == 0.48 and rows["1.jpg"].content[1].w == 0.8 and rows["1.jpg"].rotate == 90 and not rows["1.jpg"].skip
    assert rows['2 "x".jpg'].skip and rows['2 "x".jpg'].split_mode == "none"
    again = overrides.parsed(overrides.written(found))
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    nothing = found.withColumns({"skip": F.lit(False), "rotate": F.lit(None).cast("int"), "split_mode": F.lit(None).cast("string"), "content": F.lit(None).cast("map<tinyint,struct<x:double,y:double,w:double,h:double>>")})
    kept = spark.createDataFrame(found.collect(), found.schema)
    assert [r.kept for r in overrides.save(kept, str(tmp_path)).collect()] == [True] and overrides.load(spark, str(tmp_path)).count() == 2
    assert [r.kept for r in overrides.save(spark.createDataFrame(nothing.collect(), nothing.schema), str(tmp_path)).collect()] == [False]
    assert not (tmp_path / "b" / "overrides.json").exists()


def test_overrides_of_any_file_name(spark, tmp_path):
    names = ["p[1]:2.jpg", 'a "b".jpg', "x\\y.png", '{"at":1}.jpg', "tab\t.png", "日本 1.jpg", '"split":"none".gif', "]:"]
    rows = [("b", n, False, 90 * (i % 4), None, None, None, ("none", "at", None)[i % 3], 0.25 if i % 3 == 1 else None, None) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "book string, file string, skip boolean, rotate int, unwarp boolean, unwarp_curl boolean, dewarp boolean, split_mode string, split_at double, content map<tinyint,struct<x:double,y:double,w:double,h:double>>")
    again = overrides.parsed(overrides.written(df))
    assert sorted(map(str, again.select(df.columns).collect())) == sorted(map(str, df.collect()))
    (tmp_path / "b").mkdir()
    assert overrides.save(df.unionByName(df), str(tmp_path)).count() == 1 and overrides.load(spark, str(tmp_path)).count() == len(names)
    (tmp_path / "b" / "overrides.json").write_text('{"pages":{"a.jpg":')
    found = overrides.texts(spark, str(tmp_path))
    assert overrides.parsed(found).count() == 0 and [(r.book, bool(r.error)) for r in overrides.unreadable(found).collect()] == [("b", True)]


def test_boxes_in_pixels(spark):
    df = spark.createDataFrame([(0.25, 0.5, 0.5, 0.25, 400, 800), (0.5, 0.5, 0.0, 0.1, 10, 10)], "x double, y double, w double, h double, pw int, ph int")
    got = [r[0] for r in df.select(overrides.to_px(F.struct("x", "y", "w", "h"), F.col("pw"), F.col("ph"))).collect()]
    assert tuple(got[0]) == (100, 400, 200, 200) and got[1] is None


def test_names_never_clash(spark):
    df = spark.createDataFrame([(0, "a"), (1, "a"), (2, "a (2)"), (3, "A"), (4, "b"), (5, "b"), (6, "a (2)")], "i int, name string")
    got = [r.output for r in books.output_names(df, "name", ["i"]).orderBy("i").collect()]
    assert got == ["a.pdf", "a (2).pdf", "a (2) (2).pdf", "A (3).pdf", "b.pdf", "b (2).pdf", "a (2) (3).pdf"]
    files = spark.createDataFrame([("b", "7.jpg"), ("b", "99999999999999999999.jpg"), ("b", "x.jpg"), ("c", "y.jpg")], "book string, file string")
    assert dict(map(tuple, books.next_numbers(files, "book", "file").collect())) == {"b": 8, "c": 1}


def sequential_names(names):
    taken, out = set(), []
    for own in names:
        n, full = 1, own
        while full.lower() in taken:
            n += 1
            full = f"{own} ({n})"
        taken.add(full.lower())
        out.append(f"{full}.pdf")
    return out


@pytest.mark.parametrize("seed", range(4))
def test_names_equal_those_given_one_after_the_other(spark, seed):
    r = np.random.default_rng(seed)
    pool = ["a", "A", "a (2)", "a (3)", "a (2) (2)", "a (02)", "a (1)", "a (4)", "a (2) (3)", "b", "b (2)", "c (2)", "(2)", " (2)", "x\n (2)", "a (2) (2) (2)"]
    names = [str(pool[i]) for i in r.integers(0, len(pool) if seed else 4, 120)]
    df = spark.createDataFrame(list(enumerate(names)), "i int, name string").repartition(5)
    got = [x.output for x in books.output_names(df, "name", ["i"]).orderBy("i").collect()]
    assert got == sequential_names(names)


def test_book_from_end_to_end(spark, tmp_path):
    at = tmp_path / "in" / "my book"
    at.mkdir(parents=True)
    spread = lines(lines(paper(1000, 700), 60, 440, 12), 560, 940, 12)
    single = lines(paper(500, 700), 60, 440, 12)
    for name, img in {"1.png": spread, "2.png": single, "3.png": single, "10.png": np.full((700, 500, 3), (200, 20, 20), dtype=np.uint8), "4.png": np.rot90(single)}.items():
        (at / name).write_bytes(png(np.ascontiguousarray(img)))
    (at / "overrides.json").write_text('{"pages":{"3.png":{"skip":true},"4.png":{"rotate":90},"2.png":{"content":{"0":{"x":0.1,"y":0.1,"w":0.8,"h":0.8}}}}}')
    done, report = convert.convert(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", {"page_box": (500, 700)}, work=str(tmp_path / "work"))
    assert [(r.name, r.n_pages) for r in done.collect()] == [("my book", 5)]
    rows = {(r.file, r.half): r for r in report.collect()}
    assert set(rows) == {("1.png", 0), ("1.png", 1), ("2.png", None), ("4.png", None), ("10.png", None)} and all(r.error is None for r in rows.values())
    assert abs(rows["1.png", 0].gutter_x - 500) < 30 and tuple(rows["2.png", None].box) == (50, 70, 400, 560) and rows["4.png", None].width == 500
    data = (tmp_path / "out" / "my book.pdf").read_bytes()
    assert len(re.findall(rb"/DCTDecode", data)) == 5 and b"/DeviceGray" in data and len(set(re.findall(rb"/MediaBox (\[[^]]*\])", data))) == 1
    assert [tuple(r) for r in convert.status(report).collect()] == [("my book", 4, 5, 0)]
