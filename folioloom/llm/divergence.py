"""Source divergence audit by in-mapper stripes.

Every task folds whole documents into stripes: for each language and term the number of documents and the count in each
source. When a task holds CELLS counts it spills its stripes into the shuffle, which merges them by language and term; so a
term sends one row a spill, however often it occurs. Merged stripes give the divergences: a chunk of stripes and its
language's totals make the shares of every source, and each pair of sources gets the chunk's sum; the sums of all chunks
are the result. A pair's terms never stand together in one task, nor do a source's documents.

Shares are whole billionths, smoothed by two occurrences a term: 1 + floor(10**9 * (count + 2) / (total + 2 * terms)). The
divergence of two shares is floor((p - q)**2 / (p + q)). All arithmetic is in 64-bit integers and exact while totals stay
below 9 * 10**15.

Nulls: text, language and source read as empty. A language without a kept term still gives every pair of its sources, with
divergence 0, and a language with one source gives no pair. Repeated rows count as documents of their own; equal values rank
by UTF-8 order of the item. Very long texts are folded whole, one at a time. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small, stage, text_groups

LEAST, TOP, UNIT = 10, 10, 10**9
#: Counts that a task folds before it spills; counts in a chunk of merged stripes; shares held at once.
CELLS, CHUNK, DENSE = 200_000, 1 << 16, 1 << 20
PART = 1 << 20
_TERM = [*range(65, 91), *range(97, 123), *range(128, 256)]
#: Bytes of terms, A to Z in lower case; all others become spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b in _TERM else 32 for b in range(256))
_CELLS = pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))
STRIPE = "lang string, term binary, df long, cells array<struct<source:string,n:long>>"


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text: runs of ASCII letters and of all other characters from U+0080 on."""
    return text.translate(_FOLD).split()


def _spilled(held: dict) -> Iterator[pa.RecordBatch]:
    for lang, stripes in held.items():
        names = list(stripes)
        for lo in range(0, len(names), 20_000):
            part = names[lo : lo + 20_000]
            rows = [stripes[t] for t in part]
            flat = pa.StructArray.from_arrays(
                [pa.array([s for _, c in rows for s in c], pa.string()), pa.array([n for _, c in rows for n in c.values()], pa.int64())], names=["source", "n"]
            )
            offsets = pa.array(np.concatenate(([0], np.cumsum([len(c) for _, c in rows]))).astype(np.int32))
            cells = pa.ListArray.from_arrays(offsets, flat)
            yield pa.record_batch([pa.array([lang] * len(part)), pa.array(part, pa.binary()), pa.array([d for d, _ in rows], pa.int64()), cells], names=["lang", "term", "df", "cells"])


def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of (lang, source, text) rows. The empty term, which no text has, stands for the documents themselves."""
    held: dict[str, dict[bytes, tuple[int, dict[str, int]]]] = {}
    cells = 0
    for b in batches:
        for some in text_groups(b, 2, PART):
            for lang, source, text in zip(*(c.to_pylist() for c in some.columns)):
                own = held.setdefault(lang, {})
                counts = Counter(terms_of(text))
                counts[b""] = 1
                for term, n in counts.items():
                    stripe = own.get(term)
                    if stripe is None:
                        own[term] = [1, {source: n}]
                        cells += 1
                        continue
                    stripe[0] += 1
                    if source in stripe[1]:
                        stripe[1][source] += n
                    else:
                        stripe[1][source] = n
                        cells += 1
                if cells >= CELLS:
                    yield from _spilled(held)
                    held, cells = {}, 0
    yield from _spilled(held)


def stripes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST) -> DataFrame:
    """Merged stripes: lang, term, df (documents) and cells (counts by source) of every term in at least so many documents of
    its language. The empty term has the number of documents of each source."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    slim = docs.select(plain(lang_col).alias("lang"), plain(source_col).alias("source"), plain(text_col).cast("binary").alias("text"))
    parts = slim.mapInArrow(lean(fold), STRIPE).repartition("lang", "term")
    rows = parts.select("lang", "term", "df", F.posexplode("cells").alias("pos", "cell"))
    once = F.when(F.col("pos") == 0, F.col("df")).otherwise(0)
    rows = rows.groupBy("lang", "term", F.col("cell.source").alias("source")).agg(F.sum("cell.n").alias("n"), F.sum(once).alias("df"))
    merged = rows.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("cells"))
    return merged.filter((F.col("df") >= least) | (F.length("term") == 0)).withColumn("term", F.col("term").cast("string"))


def totals(merged: DataFrame) -> DataFrame:
    """lang, v (kept terms), chunks and sources (name and total of kept terms, by name) of every language."""
    terms = merged.filter("term <> ''")
    own = terms.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("total"))
    every = merged.filter("term = ''").select("lang", F.explode("cells.source").alias("source"))
    every = every.join(own, ["lang", "source"], "left").select("lang", F.struct("source", F.coalesce("total", F.lit(0)).alias("total")).alias("s"))
    every = every.groupBy("lang").agg(F.sort_array(F.collect_list("s")).alias("sources"))
    size = terms.groupBy("lang").agg(F.count("*").alias("v"), F.ceil(F.sum(F.size("cells")) / CHUNK).alias("chunks"))
    return every.join(size, "lang", "left").select("lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("chunks", F.lit(1)).alias("chunks"), "sources")


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * count / total), by long division in thousands. count is at most total."""
    out, rest = np.zeros(np.broadcast_shapes(count.shape, total.shape), dtype=np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _chunk(v: int, names: list[str], total: np.ndarray, terms: list[bytes], sizes: np.ndarray, at: np.ndarray, n: np.ndarray, top: int):
    """The pair sums of a chunk, a row of them for each source but the last (with the sources behind it), and the best terms
    of each source. at, n: source places and counts of the cells, sizes of them a term."""
    s = len(names)
    if not terms:
        for i in range(s - 1):
            yield "pair", i, np.zeros(s - 1 - i, dtype=np.int64)
        return
    rank = np.empty(len(terms), dtype=np.int64)
    rank[sorted(range(len(terms)), key=terms.__getitem__)] = np.arange(len(terms))
    ends = np.cumsum(sizes)
    step = max(1, DENSE // s)
    for lo in range(0, len(terms), step):
        hi = min(lo + step, len(terms))
        a, z = (int(ends[lo - 1]) if lo else 0), int(ends[hi - 1])
        count = np.zeros((hi - lo, s), dtype=np.int64)
        count[np.repeat(np.arange(hi - lo), sizes[lo:hi]), at[a:z]] = n[a:z]
        p = shares(count + 2, total[None, :] + 2 * v)
        q = shares(count.sum(axis=1) + 2, total.sum(keepdims=True) + 2 * v)
        for i in range(s):
            if i < s - 1:
                yield "pair", i, divergence(p[:, i : i + 1], p[:, i + 1 :]).sum(axis=0)
            more = np.flatnonzero((count[:, i] > 0) & (p[:, i] > q))
            value = divergence(p[more, i], q[more])
            best = np.lexsort((rank[lo + more], -value))[:top]
            yield "term", i, [(terms[lo + k], int(x)) for k, x in zip(more[best].tolist(), value[best].tolist())]


def _emit(top: int):
    names = ["lang", "source", "part", "item", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[list[str], dict[int, np.ndarray]]] = {}
        held = 0

        def pairs() -> Iterator[pa.RecordBatch]:
            for lang, (own, rows) in sums.items():
                for i, x in rows.items():
                    yield pa.record_batch([pa.array([lang] * len(x)), pa.array([own[i]] * len(x)), pa.array(["pair"] * len(x)), pa.array(own[i + 1 :]), pa.array(x)], names=names)
            sums.clear()

        for b in batches:
            for row in (b.slice(k, 1) for k in range(b.num_rows)):
                lang, v = row["lang"][0].as_py(), row["v"][0].as_py()
                sources, stripe = row["sources"][0].values, row["stripes"][0].values
                own, total = sources.field("source"), sources.field("total").to_numpy(zero_copy_only=False).astype(np.int64)
                cells = stripe.field("cells")
                flat = cells.flatten()
                at = pc.index_in(flat.field("source"), value_set=own).to_numpy(zero_copy_only=False).astype(np.int64)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = pc.list_value_length(cells).to_numpy(zero_copy_only=False).astype(np.int64)
                terms = stripe.field("term").cast(pa.binary()).to_pylist()
                own = own.to_pylist()
                for part, i, got in _chunk(v, own, total, terms, sizes, at, n, top):
                    if part == "pair":
                        rows = sums.setdefault(lang, (own, {}))[1]
                        held += 0 if i in rows else len(got)
                        rows[i] = rows[i] + got if i in rows else got
                        if held > 4 * DENSE:
                            yield from pairs()
                            held = 0
                    elif got:
                        yield pa.record_batch([pa.array([lang] * len(got)), pa.array([own[i]] * len(got)), pa.array(["term"] * len(got)), pa.array([t.decode() for t, _ in got]), pa.array([x for _, x in got], pa.int64())], names=names)
        yield from pairs()

    return run


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value and rank: the divergence of each source from each other one of its language (part
    "pair"), and its terms that stand out most against the whole language (part "term", to rank top)."""
    merged = stage(stripes(docs, text_col, lang_col, source_col, least), "divergence-stripes")
    of = stage(totals(merged), "divergence-totals")
    groups = of.agg(F.sum(F.size("sources"))).first()[0] or 0
    hint = F.broadcast if groups <= 100_000 else lambda df: df
    place = F.pmod(F.xxhash64("term"), F.col("chunks")).alias("chunk")
    chunks = merged.filter("term <> ''").join(small(of.select("lang", "chunks")), "lang").groupBy("lang", place).agg(F.collect_list(F.struct("term", "cells")).alias("stripes"))
    none = of.select("lang", F.lit(-1).cast("long").alias("chunk"), F.from_json(F.lit("[]"), "array<struct<term:string,cells:array<struct<source:string,n:bigint>>>>").alias("stripes"))
    rows = chunks.unionByName(none).join(hint(of.drop("chunks")), "lang").select("lang", "v", "sources", "stripes")
    found = rows.mapInArrow(lean(_emit(top)), "lang string, source string, part string, item string, value long")
    found = found.groupBy("lang", "part", "source", "item").agg(F.sum("value").alias("value"))
    back = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).otherwise(F.array(F.struct("source", "item")))
    both = found.select("lang", "part", "value", F.explode(back).alias("o")).select("lang", "o.source", "part", "o.item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return both.withColumn("rank", rank).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
