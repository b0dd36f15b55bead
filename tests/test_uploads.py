"""Numbering of uploads over batches and restarts."""

import json
import os
import time
from pathlib import Path

from folioloom.streaming import uploads

FIELDS = "book string, path string, file string, sent long"


def arrive(at: Path, n: int, rows: list) -> None:
    lines = "".join(json.dumps(dict(zip(("book", "path", "file", "sent"), r))) + "\n" for r in rows)
    (at / f"_{n}.part").write_text(lines)
    os.utime(at / f"_{n}.part", (1e9 + n, 1e9 + n))  # files are read in the order of their times
    (at / f"_{n}.part").rename(at / f"{n}.json")


def test_numbers_have_no_gaps_over_batches_and_restarts(spark, tmp_path):
    inbox, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    inbox.mkdir()
    stored = spark.createDataFrame([("b", "0007.jpg"), ("b", "x.jpg"), ("old", "3.png")], "book string, file string")

    def run():
        stream = spark.readStream.schema(FIELDS).option("maxFilesPerTrigger", "1").json(str(inbox))
        q = uploads.numbered(stream, stored, idle=None).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        try:
            assert q.awaitTermination(180)
        finally:
            q.stop()

    arrive(inbox, 0, [("b", "/u/z", "z.JPG", 5), ("b", "/u/a", "a.png", 9), ("b", "/u/t", "t.txt", 1), ("c", "/u/q", "q.webp", 1), (None, "/u/n", "n.jpg", 1)])
    arrive(inbox, 1, [("b", "/u/m", "m.jpg", 2), ("b", "/u/l", "l.jpg", None), ("c", "/u/a", "a.png", 1)])
    run()
    arrive(inbox, 2, [("b", "/u/z", "z.JPG", 5), ("c", "/u/k", "k.gif", 1)])
    run()
    run()  # nothing new
    got = {(r.book, r.path, r.number, r.stored) for r in spark.read.parquet(out).filter("number is not null").collect()}
    assert {x for x in got if x[0] == "c"} == {("c", "/u/q", 1, "0001.webp"), ("c", "/u/a", 2, "0002.png"), ("c", "/u/k", 3, "0003.gif")}
    b = sorted((x for x in got if x[0] == "b"), key=lambda x: x[2])
    assert [x[2] for x in b] == [8, 9, 10, 11, 12] and {x[1] for x in b} == {"/u/z", "/u/a", "/u/m", "/u/l"}
    order = [x[1] for x in b]
    assert order.index("/u/a") == order.index("/u/z") + 1 and order.index("/u/m") == order.index("/u/l") + 1 and b[-1][1:] == ("/u/z", 12, "0012.jpg")


def test_quiet_books_close_and_are_made_anew(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "books"
    inbox.mkdir()
    (tmp_path / "up").mkdir()
    for name in ("1.jpg", "2.jpg", "3.png"):
        (tmp_path / "up" / name).write_bytes(name.encode() * 1000)
    row = lambda book, name, sent: (book, f"file://{tmp_path}/up/{name}", name, sent)
    arrive(inbox, 0, [row("b", "2.jpg", 1), row("b", "1.jpg", 2), row("c", "3.png", 1)])
    closed = []
    q = uploads.take_in(spark.readStream.schema(FIELDS).json(str(inbox)), f"file://{root}", str(tmp_path / "state"), idle=3000, rebuild=lambda b, n: closed.extend((r.book, r.files) for r in b.collect()), every="500 milliseconds")
    try:
        end = time.time() + 120
        while len(closed) < 2 and time.time() < end and q.isActive:
            time.sleep(0.5)
        arrive(inbox, 1, [row("b", "3.png", 3)])
        while len(closed) < 3 and time.time() < end and q.isActive:
            time.sleep(0.5)
        assert q.exception() is None and sorted(closed[:2]) == [("b", 2), ("c", 1)] and closed[2:] == [("b", 1)]
    finally:
        q.stop()
    stored = {p.relative_to(root).as_posix(): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert stored == {"b/0001.jpg": b"2.jpg" * 1000, "b/0002.jpg": b"1.jpg" * 1000, "b/0003.png": b"3.png" * 1000, "c/0001.png": b"3.png" * 1000}
    assert {(r.book, r.file) for r in uploads.stored_already(spark, str(root)).collect()} == {("b", "0001.jpg"), ("b", "0002.jpg"), ("b", "0003.png"), ("c", "0001.png")}
