"""Events of conversions that are broken off and go on, and of streams."""

import json
import os
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.operators import convert, progress
from test_sources import png

PLAIN = {"page_box": (50, 70), "deskew": False, "dewarp": False, "illumination": False, "split": "none"}


@pytest.fixture
def root(tmp_path):
    for b, n in (("one", 5), ("two", 3)):
        (tmp_path / "in" / b).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "in" / b / f"{i}.png").write_bytes(png(np.full((14, 10, 3), 40 * i, dtype=np.uint8)))
    (tmp_path / "in" / "two" / "x.jpg").write_bytes(b"broken")
    return str(tmp_path / "in")


def test_a_conversion_goes_on_behind_its_last_part(spark, root, tmp_path, monkeypatch):
    p = progress.Progress(spark, str(tmp_path / "progress"))
    assert p.events().count() == 0
    real, calls = convert.folio.pages, []

    def failing(*a, part, **k):
        calls.append(part)
        if len(calls) == 3:
            raise RuntimeError("broken off")
        return real(*a, part=part, **k)

    monkeypatch.setattr(convert.folio, "pages", failing)
    run = lambda: convert.convert(spark, root, f"file://{tmp_path}/out", PLAIN, work=str(tmp_path / "work"), progress=p, parts=4)
    with pytest.raises(RuntimeError):
        run()
    half = {r.book: r for r in progress.current(p.events()).collect()}
    assert set(half) == {"one", "two"} and half["one"].total == 5 and half["two"].total == 4 and all(r.kind == "processed" and abs(r.share - 0.8 * r.done / r.total) < 1e-9 for r in half.values())
    first = {f.name: f.stat().st_mtime_ns for i in (0, 1) for f in Path(p.part(i)).glob("*.parquet")}
    # part 1 loses its commit, as if the driver had died while writing
    os.remove(f"{p.part(1)}/_SUCCESS")
    done, report = run()
    assert {(r.name, r.n_pages) for r in done.collect()} == {("one", 5), ("two", 3)} and report.count() == 9
    again = {f.name: f.stat().st_mtime_ns for i in (0, 1) for f in Path(p.part(i)).glob("*.parquet")}
    kept = {f.name for f in Path(p.part(0)).glob("*.parquet")}
    assert kept and all(again[n] == first[n] for n in kept) and not set(again) - kept & set(first)
    events = p.events().collect()
    for book, total in (("one", 5), ("two", 4)):
        counts = [r.done for r in sorted((r for r in events if r.book == book and r.kind == "processed"), key=lambda r: r.n)]
        assert counts == sorted(counts) and len(counts) == 4 and counts[-1] == total
    last = {r.book: r for r in progress.current(p.events()).collect()}
    assert all(r.kind == "finished" and r.share is None for r in last.values()) and last["two"].done == last["two"].total == 3
    texts = {r.line for r in progress.line(p.events()).collect()}
    assert "one: processed 5/5" in texts and f"one: finished, file://{tmp_path}/out/one.pdf" in texts
    assert sum(r.errors or 0 for r in events if r.book == "two" and r.kind == "processed") == 1


def test_streams_report_each_batch_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    listener = progress.StreamProgress(str(tmp_path / "events"), "uploads")
    spark.streams.addListener(listener)
    try:
        def run():
            stream = spark.readStream.schema("book string, n long").option("maxFilesPerTrigger", "1").json(str(inbox))
            seen = stream.observe("uploads", F.count("*").alias("files"), F.sum("n").alias("bytes"))
            q = seen.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert q.awaitTermination(120)

        for i in range(2):
            (inbox / f"{i}.json").write_text("".join(json.dumps({"book": "b", "n": 10 * i + k}) + "\n" for k in range(3)))
        run()
        (inbox / "2.json").write_text(json.dumps({"book": "c", "n": 7}) + "\n")
        run()
        end = time.time() + 30
        while time.time() < end and len(list((tmp_path / "events").glob("*.jsonl"))) < 2:
            time.sleep(0.2)
        rows = {r.batch: r for r in listener.batches(spark).collect()}
        assert {b: r.rows for b, r in rows.items()} == {0: 3, 1: 3, 2: 1} and rows[2].metrics == {"files": 1, "bytes": 7} and len({r.query for r in rows.values()}) == 1
    finally:
        spark.streams.removeListener(listener)
