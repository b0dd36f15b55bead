"""Only what changed is made anew."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import convert, rebuild
from test_progress import PLAIN
from test_sources import png

PAGE = png(np.full((14, 10, 3), 90, dtype=np.uint8))


def test_books_are_rebuilt_where_something_changed(spark, tmp_path, monkeypatch):
    at = tmp_path / "in"
    for book, n in (("x/vol", 2), ("y/vol", 1), ("z", 1)):
        (at / book).mkdir(parents=True)
        for i in range(n):
            (at / book / f"{i}.png").write_bytes(PAGE)
    made = []
    real = convert.convert
    monkeypatch.setattr(convert, "convert", lambda *a, only=None, **k: made.append(only) or real(*a, only=only, **k))

    def run(options=PLAIN):
        made.clear()
        changed, report = rebuild.rebuild(spark, str(at), f"file://{tmp_path}/out", str(tmp_path / "manifests"), options, work=str(tmp_path / "work"))
        return made[0] if made else [], {(r.book, r.kind, r.name, r.change) for r in changed.collect()}, {(r.book, r.file) for r in report.collect()}

    books, changed, report = run()
    assert books == ["x/vol", "y/vol", "z"] and len(report) == 4 and ("z", "image", "0.png", "added") in changed and ("z", "output", "", "missing") in changed
    assert sorted(p.name for p in (tmp_path / "out").glob("*.pdf")) == ["vol (2).pdf", "vol.pdf", "z.pdf"]
    assert run() == ([], set(), set())
    # an override touches its book alone; one that overrides nothing touches none
    (at / "y/vol/overrides.json").write_text(json.dumps({"pages": {"0.png": {"rotate": 90}}}))
    assert run() == (["y/vol"], {("y/vol", "override", "0.png", "added")}, {("y/vol", "0.png")})
    (at / "z/overrides.json").write_text(json.dumps({"pages": {"0.png": {}}}))
    assert run()[0] == []
    # a missing output, a new image, a book whose name moves another one's
    (tmp_path / "out/z.pdf").unlink()
    assert run()[:2] == (["z"], {("z", "output", "", "missing")})
    (at / "x/vol/9.png").write_bytes(PAGE)
    assert run() == (["x/vol"], {("x/vol", "image", "9.png", "added")}, {("x/vol", f"{i}.png") for i in (0, 1, 9)})
    (at / "a/vol").mkdir(parents=True)
    (at / "a/vol/1.png").write_bytes(PAGE)
    books, changed, _ = run()
    assert books == ["a/vol", "x/vol", "y/vol"] and {c for c in changed if c[1] == "output" and c[3] == "changed"} == {("x/vol", "output", "", "changed"), ("y/vol", "output", "", "changed")}
    # other options touch all; a book that is gone is reported only
    assert run(PLAIN | {"quality": 50})[0] == ["a/vol", "x/vol", "y/vol", "z"]
    (at / "z/0.png").unlink()
    books, changed, _ = run(PLAIN | {"quality": 50})
    assert books == [] and ("z", "image", "0.png", "removed") in changed and (tmp_path / "out/z.pdf").exists()


def test_a_rebuild_that_fails_is_done_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in/b").mkdir(parents=True)
    (tmp_path / "in/b/1.png").write_bytes(PAGE)
    run = lambda: rebuild.rebuild(spark, str(tmp_path / "in"), f"file://{tmp_path}/out", str(tmp_path / "manifests"), PLAIN, work=str(tmp_path / "work"))
    with monkeypatch.context() as m:
        m.setattr(convert, "convert", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            run()
    assert rebuild.Versions(spark, str(tmp_path / "manifests")).last() == 0
    assert run()[1].count() == 1 and rebuild.Versions(spark, str(tmp_path / "manifests")).last() == 1
    assert not Path(tmp_path / "manifests/version=2").exists()
    # a version without its mark of success does not count
    spark.range(0).select(*[F.lit("").alias(c) for c in ("book", "kind", "name", "mark")]).write.parquet(str(tmp_path / "manifests/version=2"))
    (tmp_path / "manifests/version=2/_SUCCESS").unlink()
    assert rebuild.Versions(spark, str(tmp_path / "manifests")).last() == 1
