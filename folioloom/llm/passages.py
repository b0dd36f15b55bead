"""The Spark jobs that remove repeated passages: windows of W tokens that occur before.

1. Each task lists the anchors of its texts (see repeats.py) and settles those whose gram and context it has seen itself.
2. The others meet by gram. An index of the shard tells which had the same context before (all their windows repeat), and
   which share their gram with other contexts only (contested: some of their windows may repeat).
3. Contested anchors fetch their contexts from the texts and meet by gram again, where the operator's matcher (suffix
   arrays, FM-indexes) finds the windows that repeat. Grams with over HOT contexts would gather too many rows in a task: their windows meet one by one, by window, after each
   task has settled those that it has seen itself. Grams that are common in a sample of SAMPLE documents are dealt by gram
   and context from the start, so that no task gathers one; the sample decides where rows meet, never what is found.
4. The ranges found go back to the texts.

Grams and contexts are told apart by 127 bits together, windows of one gram by 64 bits, of grams with many contexts by 64
bits among all of these.

A window's place in order is (document, start). Documents with equal ids are told apart by a number kept in the upper bits
of positions (equal ids and equal texts are one document, repeated). A null id counts as the smallest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean
from .repeats import Hashes, LevelFamily, anchors, gram_minima, mix

#: Contexts of one gram that are compared in one task; contexts and anchors that are handled at once.
HOT, CHUNK, FLUSH = 1000, 4_000, 1_000_000
#: Documents in which common grams are looked for, and in how many of them a common gram stands.
SAMPLE, COMMON = 20_000, 20
SHIFT = 40
_PLACE = (1 << SHIFT) - 1
NULL_ID = -(2**63)
_BYTES = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


class Tokens:
    """How a text becomes tokens. width: bytes that a token takes in a stored context."""

    def __init__(self, window: int, gram: int, width: int, encode: Callable, values: Callable):
        self.w, self.k, self.width, self.encode, self.values = window, gram, width, encode, values

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stored tokens of all texts (n x width), and where each text starts and how long it is."""
        parts = [self.encode(t) for t in texts]
        lens = np.array([len(p) // self.width for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.uint8).reshape(-1, self.width), np.cumsum(lens) - lens, lens


def byte_values(stored: np.ndarray) -> np.ndarray:
    return _BYTES[stored[..., 0]]


def hash_values(stored: np.ndarray) -> np.ndarray:
    out = np.zeros((*stored.shape[:-1], 8), dtype=np.uint8)
    out[..., : stored.shape[-1]] = stored
    return mix(out.view(np.uint64)[..., 0] + np.uint64(1))


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """id (never null), r (told apart among equal ids) and text; and which of them tell documents apart."""
    slim = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    if slim.groupBy("id").count().filter("count > 1").take(1):
        digest = F.xxhash64("text").alias("digest")
        ranks = slim.select("id", digest).distinct().withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("digest")).cast("long") - 1)
        return slim.withColumn("digest", F.xxhash64("text")).join(ranks, ["id", "digest"]).select("id", "r", "text"), ["id", "r"]
    return slim.select("id", F.lit(0).cast("long").alias("r"), "text"), ["id"]


def _some(batches: Iterator[pa.RecordBatch], size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about so many bytes of text, which is the column text."""
    for b in batches:
        lens = pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(lens) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def _rows(**columns) -> pa.RecordBatch:
    return pa.record_batch([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def common_grams(texts: DataFrame, tokens: Tokens) -> np.ndarray:
    """The anchors' grams that stand in at least COMMON of about SAMPLE documents; a few for each sampled text at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches):
            stored, starts, lens = tokens(b.column("text").to_pylist())
            h = Hashes(tokens.values(stored))
            at = anchors(h, starts, lens, tokens.w, tokens.k)
            d = np.searchsorted(starts, at, side="right") - 1
            g = h(at, at + tokens.k)
            order = np.lexsort((d, g))
            g, d = g[order], d[order]
            new = np.concatenate(([True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])))[: len(g)]
            g, n = np.unique(g[new], return_counts=True)
            yield _rows(g=g.view(np.int64), n=n)

    share = F.lit(min(1.0, SAMPLE / max(1, texts.count())))
    some = texts.filter(F.pmod(F.xxhash64("id", "r", F.lit("sample")), F.lit(1_000_000)) < share * 1_000_000)
    got = some.mapInArrow(lean(run), "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON).select("g").toPandas()
    return np.sort(got["g"].to_numpy(np.int64).view(np.uint64))


def _anchor_rows(tokens: Tokens, other: bool, common):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def settled():
            g, ctx, doc, pos, left, right = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((pos, doc))
            g, ctx, doc, pos, left, right = (x[order] for x in (g, ctx, doc, pos, left, right))
            seen = LevelFamily(other).add(g, ctx, doc, pos)
            new = ~seen
            # the last bit tells grams of their own from common ones, which are dealt by gram and context
            hot = np.isin(g, common.value)
            g = np.where(hot, mix(g ^ (ctx * np.uint64(31))), g) & ~np.uint64(1) | hot.astype(np.uint64)
            yield _rows(g=g[new].view(np.int64), ctx=ctx[new].view(np.int64), id=doc[new], pos=pos[new], data=pa.nulls(int(new.sum()), pa.binary()))
            # what is settled only passes on: ranges of each document, dealt by document
            doc, r, pos = doc[seen], pos[seen] >> SHIFT, pos[seen] & _PLACE
            if len(doc):
                owner = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (r[1:] != r[:-1]))))
                have, packed = _packed(owner, pos - left[seen], pos + right[seen])
                at = np.searchsorted(owner, have)
                yield _rows(g=mix(doc[at].view(np.uint64)).view(np.int64), ctx=np.zeros(len(at), dtype=np.int64), id=doc[at], pos=-1 - (r[at] << SHIFT), data=packed)

        for b in _some(batches):
            stored, starts, lens = tokens(b.column("text").to_pylist())
            h = Hashes(tokens.values(stored))
            at = anchors(h, starts, lens, tokens.w, tokens.k)
            if len(at):
                d = np.searchsorted(starts, at, side="right") - 1
                # the last text that starts there, where empty ones start there too, is the one with tokens
                left, right = np.minimum(tokens.w - tokens.k, at - starts[d]), np.minimum(tokens.w, starts[d] + lens[d] - at)
                ctx = mix(h(at - left, at + right) + (left * 1024 + right).astype(np.uint64))
                ids, r = (b.column(c).to_numpy() for c in ("id", "r"))
                held.append((h(at, at + tokens.k), ctx, ids[d], at - starts[d] + (r[d] << SHIFT), left, right))
                n += len(at)
                if n >= FLUSH:
                    yield from settled()
                    held, n = [], 0
        if held:
            yield from settled()

    return run


def _index(other: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = LevelFamily(other)
        for b in batches:
            g, ctx, doc, pos = (c.to_numpy(zero_copy_only=False) for c in b.columns[:4])
            done = np.flatnonzero(pos < 0)
            if len(done):
                yield _rows(id=doc[done], pos=-1 - pos[done], g=np.zeros(len(done), dtype=np.int64), what=np.full(len(done), 3, dtype=np.int32), data=b.column(4).take(pa.array(done)))
            new = np.flatnonzero(pos >= 0)
            seen = new[family.add(g[new].view(np.uint64), ctx[new].view(np.uint64), doc[new], pos[new])]
            yield _rows(id=doc[seen], pos=pos[seen], g=np.zeros(len(seen), dtype=np.int64), what=np.zeros(len(seen), dtype=np.int32), data=pa.nulls(len(seen), pa.binary()))
        g, ctx, doc, pos = family.entries()
        order = np.lexsort((ctx, g))
        g, ctx, doc, pos = (x[order] for x in (g, ctx, doc, pos))
        _, first, n = np.unique(g, return_index=True, return_counts=True)
        if len(g):
            several = np.maximum.reduceat(ctx, first) != np.minimum.reduceat(ctx, first)
            what = np.where(g & np.uint64(1), 2, np.repeat(np.where(several, np.where(n > HOT, 2, 1), 0), n))
            keep = what > 0
            yield _rows(id=doc[keep], pos=pos[keep], g=g[keep].view(np.int64), what=what[keep].astype(np.int32), data=pa.nulls(int(keep.sum()), pa.binary()))

    return run


def _merged(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Ranges as sorted, disjoint pairs."""
    if not len(lo):
        return np.empty((0, 2), dtype=np.int64)
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.concatenate(([True], lo[1:] > hi[:-1]))
    return np.stack((lo[new], np.append(hi[:-1][new[1:]], hi[-1])), axis=1)


def _packed(owner: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Owners (small numbers) that have ranges, ascending, and each one's merged ranges as bytes."""
    m = _merged(lo + (owner << SHIFT), hi + (owner << SHIFT))
    have, first = np.unique(m[:, 0] >> SHIFT, return_index=True)
    return have, pa.array([(x & _PLACE).tobytes() for x in np.split(m, first[1:])] if len(have) else [], pa.binary())


def _contexts(tokens: Tokens, other: bool):
    """From texts with their marks to rows of three kinds: 0 ranges that are settled, 1 contexts, 2 windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, reach = tokens.width, tokens.w - tokens.k
        for b in _some(batches):
            keep = np.flatnonzero(b.column("marks").is_valid().to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            b = b.take(pa.array(keep))
            stored, starts, lens = tokens(b.column("text").to_pylist())
            ids, r = (b.column(c).to_numpy() for c in ("id", "r"))
            marks = b.column("marks")
            d = np.repeat(np.arange(b.num_rows), marks.value_lengths().to_numpy(zero_copy_only=False))
            flat = marks.flatten()
            pos, g, what = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ready = what == 3
            got = flat.field(3).filter(pa.array(ready)).to_pylist()
            size = [len(x) // 16 for x in got]
            ready_d, ready = np.repeat(d[ready], size), np.frombuffer(b"".join(got), dtype=np.int64).reshape(-1, 2)
            pos = pos - (r[d] << SHIFT)
            left, right = np.minimum(reach, pos), np.minimum(tokens.w, lens[d] - pos)
            full = what == 0
            lo_d, lo, hi = [d[full], ready_d], [(pos - left)[full], ready[:, 0]], [(pos + right)[full], ready[:, 1]]
            hot = np.flatnonzero(what == 2)
            rows = []
            if len(hot):
                h = Hashes(tokens.values(stored))
                n = (left + right - tokens.w + 1)[hot]
                who = np.repeat(hot, n)
                step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
                start = (pos - left)[who] + step
                once = np.unique(d[who] << SHIFT | start)
                wd, start = once >> SHIFT, once & _PLACE
                hashes = h(starts[wd] + start, starts[wd] + start + tokens.w)
                order = np.lexsort((start, r[wd], ids[wd]))
                wd, start, hashes = wd[order], start[order], hashes[order]
                before = _before(hashes, ids[wd], start + (r[wd] << SHIFT), other)
                lo_d.append(wd[before])
                lo.append(start[before])
                hi.append(start[before] + tokens.w)
                wd, start, hashes = wd[~before], start[~before], hashes[~before]
                rows.append((hashes.view(np.int64), np.full(len(wd), 2, dtype=np.int32), ids[wd], start + (r[wd] << SHIFT), np.zeros(len(wd), dtype=np.int32), pa.nulls(len(wd), pa.binary())))
            some = np.flatnonzero(what == 1)
            if len(some):
                # of the windows around an anchor, those in which no gram is less: equal windows agree in that
                grams, least = gram_minima(Hashes(tokens.values(stored)), tokens.w, tokens.k)
                p, n = starts[d[some]] + pos[some], (left + right - tokens.w + 1)[some]
                first = np.cumsum(n) - n
                at = np.arange(n.sum()) + np.repeat(p - left[some] - first, n)
                own = least[at] == np.repeat(grams[p], n)
                a = np.minimum.reduceat(np.where(own, at, len(stored)), first)
                z = np.maximum.reduceat(np.where(own, at, -1), first) + tokens.w
                raw = stored.tobytes()
                data = pa.array([raw[i:j] for i, j in zip((a * width).tolist(), (z * width).tolist())], pa.binary())
                rows.append((g[some], np.full(len(some), 1, dtype=np.int32), ids[d[some]], pos[some] + (r[d[some]] << SHIFT), (p - a).astype(np.int32), data))
            lo_d, lo, hi = np.concatenate(lo_d), np.concatenate(lo), np.concatenate(hi)
            have, packed = _packed(lo_d, lo, hi)
            rows.append((mix(ids[have].view(np.uint64)).view(np.int64), np.zeros(len(have), dtype=np.int32), ids[have], r[have] << SHIFT, np.zeros(len(have), dtype=np.int32), packed))
            for x in rows:
                yield _rows(**dict(zip(("g", "kind", "id", "pos", "left", "data"), x)))

    return run


def _before(h: np.ndarray, doc: np.ndarray, pos: np.ndarray, other: bool) -> np.ndarray:
    """Which entries, in order, have an equal one at an earlier place (or in a document before theirs)."""
    code, uniq = pd.factorize(h)
    first = np.empty(len(uniq), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    first = first[code]
    return doc[first] < doc if other else (doc[first] != doc) | (pos[first] != pos)


def _resolve(tokens: Tokens, other: bool, matcher: Callable):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = matcher(tokens)
        held: list = []
        size = 0
        window = (None, 0, 0)  # the last window, and the first place that has it

        def settle(upto: int | None):
            """Match the contexts held; if they come by gram, all but those of the last gram unless upto is None."""
            nonlocal held, size
            g, doc, pos, left = (np.concatenate([x[i] for x in held]) for i in range(4))
            data = [y for x in held for y in x[4]]
            n = len(g) if upto is None or not match.by_gram else int(np.searchsorted(g != g[-1], False)) if g[0] != g[-1] else 0
            held, size = ([(g[n:], doc[n:], pos[n:], left[n:], data[n:])] if n < len(g) else []), len(g) - n
            cuts = np.append(np.flatnonzero(np.diff(g[:n], prepend=g[0] - 1 if n else 0)) if match.by_gram else np.arange(n), n)  # grams stay together
            a = 0
            while a < n:
                z = int(cuts[min(np.searchsorted(cuts, a + CHUNK), len(cuts) - 1)])
                at, lo, hi = match.add(g[a:z], doc[a:z], pos[a:z], left[a:z], data[a:z])
                p = pos[a:z][at]
                r, p = p >> SHIFT, p & _PLACE
                yield _rows(id=doc[a:z][at], r=r, data=pa.array([x.tobytes() for x in np.stack((p + lo, p + hi + tokens.w), axis=1)], pa.binary()))
                a = z

        for b in batches:
            kind, doc, pos = (b.column(c).to_numpy(zero_copy_only=False) for c in ("kind", "id", "pos"))
            done = np.flatnonzero(kind == 0)
            if len(done):
                yield _rows(id=doc[done], r=pos[done] >> SHIFT, data=b.column("data").take(pa.array(done)))
            some = np.flatnonzero(kind == 1)
            if len(some):
                held.append((b.column("g").to_numpy()[some], doc[some], pos[some], b.column("left").to_numpy()[some].astype(np.int64), b.column("data").take(pa.array(some)).to_pylist()))
                size += len(some)
                if size >= CHUNK:
                    yield from settle(1)
            hot = np.flatnonzero(kind == 2)
            if len(hot):
                h, d, p = b.column("g").to_numpy()[hot], doc[hot], pos[hot]
                new = np.concatenate(([h[0] != window[0]], h[1:] != h[:-1]))
                first = np.maximum.accumulate(np.where(new, np.arange(len(h)), -1))
                first_doc, first_pos = (np.where(first < 0, old, x[np.maximum(first, 0)]) for old, x in ((window[1], d), (window[2], p)))
                hit = first_doc < d if other else (first_doc != d) | (first_pos != p)
                window = (h[-1], first_doc[-1], first_pos[-1])
                d = d[hit]
                p = p[hit]
                r, p = p >> SHIFT, p & _PLACE
                yield _rows(id=d, r=r, data=pa.array([x.tobytes() for x in np.stack((p, p + tokens.w), axis=1)], pa.binary()))
        if held:
            yield from settle(None)

    return run


def remove(docs: DataFrame, tokens: Tokens, other: bool, matcher: type, finish: Callable, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id and the columns that finish(text, ranges) gives, ranges being disjoint pairs of tokens.

    other: a window repeats only what a document with a smaller id has. matcher: what compares contested contexts. Each
    task makes one from tokens and adds contexts to it (gram, document, place, tokens before the gram, stored tokens), in
    document order or, if it is by_gram, gram by gram. It answers which of them have a window that was there before, and
    the first and last such window's start relative to the anchor: all windows of a context hold its gram, so what they
    cover together is one range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts, key = numbered(docs, id_col, text_col)
    dealt = texts.repartition(parts, *key)
    common = spark.sparkContext.broadcast(common_grams(texts, tokens))
    found = texts.mapInArrow(lean(_anchor_rows(tokens, other, common)), "g long, ctx long, id long, pos long, data binary")
    found = found.repartition(parts, "g").sortWithinPartitions("id", "pos").mapInArrow(lean(_index(other)), "id long, pos long, g long, what int, data binary")
    marks = found.withColumn("r", F.shiftright("pos", SHIFT)).groupBy(*key).agg(F.collect_list(F.struct("pos", "g", "what", "data")).alias("marks"))
    open_ = dealt.join(marks, key, "left").select("id", "r", "text", "marks").mapInArrow(lean(_contexts(tokens, other)), "g long, kind int, id long, pos long, left int, data binary")
    by = F.col("g") if matcher.by_gram else F.when(F.col("kind") == 2, F.col("g"))
    ranges = open_.repartition(parts, "g").sortWithinPartitions("kind", by, "id", "pos").mapInArrow(lean(_resolve(tokens, other, matcher)), "id long, r long, data binary")
    ranges = ranges.groupBy(*key).agg(F.collect_list("data").alias("ranges"))

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _some(batches):
            out = []
            for text, rs in zip(b.column("text").to_pylist(), b.column("ranges").to_pylist()):
                x = np.frombuffer(b"".join(rs or []), dtype=np.int64).reshape(-1, 2)
                out.append(finish(text, _merged(x[:, 0], x[:, 1])))
            cols = pa.Table.from_pylist(out) if out else None
            ids = b.column("id").to_pylist()
            yield pa.record_batch([pa.array([None if i == NULL_ID else i for i in ids], pa.int64()), *(cols.column(c).combine_chunks() for c in names)], names=["id", *names])

    names = [x.split()[0] for x in schema.split(", ")]
    return dealt.join(ranges, key, "left").select("id", "text", "ranges").mapInArrow(lean(last), f"id long, {schema}")
