"""N-gram Jaccard join: documents link when their sets of word n-grams are at least THRESHOLD alike.

Sets are arrays of 64-bit n-gram hashes in one global order: by hash, with the corpus's most frequent n-grams last. Copies
fall together first (one representative a set). Then two rounds of candidate pairs are verified exactly:

* MinHash bands link groups of near copies as stars around their smallest id, so that no group emits all its pairs.
* Prefix filtering completes the join. Sets that link have a first n-gram in common, in the global order, that stands among
  the first n - ceil(t * n) + 1 of both; what they share lies in it and behind it, so the shorter remainder bounds the
  overlap. A pair is a candidate where an n-gram's positions leave room for a link, unless both are connected already (a
  component needs no second link) or parity bitmaps of the sets exclude it. Members with a partner leave their group first,
  once each; pairs are then compared by bitmap inside the group, and only what stays is written. Groups of one n-gram with
  over BLOCK members are dealt as blocks that meet pairwise in tasks of their own.

Verification is a prefix-tree join: the partners of a probe set are kept in order, which is a trie's depth-first order; a
partner starts from the overlap at its last common node with the one before, and a subtree is left as soon as the overlap
so far and the n-grams left cannot reach the threshold. Components come from min-label propagation with pointer jumping.

Nulls: a null text or one without words has an empty set and no link. Rows with a null id link as documents of their own, one
a text; their component is the smallest id that they reach, null if there is none. Ids lie below 2**62. Rows that share an id
are one document, linked with all that any of them is linked with. Very long texts are one
set each, held in one task at a time. An empty table gives an empty result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small, stage, text_groups
from .words import PART, word_hashes

N, THRESHOLD = 5, (80, 100)
BANDS, ROWS = 6, 4
#: The global order puts n-grams of frequent cells last, a cell being the n-grams whose hashes share their first CELL bits:
#: cells that over SHARE of a partition's documents hit, FREQUENT of them at most. Only the cost depends on these.
CELL, SHARE, FREQUENT = 22, 0.002, 200_000
#: Bits of the smallest parity bitmap; larger sets have twice their size in bits, to the next power of two.
BITMAP = 1024
#: Ids that a side may have to be broadcast; partners of a probe in one task, and bytes of them held at once.
IDS, PARTNERS, HELD = 500_000, 256, 16 << 20
#: Members of one prefix n-gram that meet in one task; prefix n-grams that are counted or rows that are paired at once.
BLOCK, FLUSH = 2000, 100_000
#: Pairs of bitmaps compared at once; the least id given to a row without one.
COMPARED, NAMELESS = 50_000, 1 << 62
_MUL = np.uint64(0x9E3779B97F4A7C15)


def shingles(texts: list[str | None], n: int = N) -> list[np.ndarray]:
    """Distinct n-gram hashes of each text, ascending; a text with fewer words has one for its whole sequence."""
    h, count = word_hashes([t or "" for t in texts], lower=True)
    at = np.cumsum(count) - count
    long = np.full(max(0, len(h) - n + 1), n, dtype=np.uint64)
    for i in range(n):
        long = _fold(long, h[i : len(h) - n + 1 + i])
    out = []
    for lo, m in zip(at.tolist(), count.tolist()):
        if m >= n:
            out.append(np.unique(long[lo : lo + m - n + 1]))
        else:
            x = np.full(min(m, 1), m, dtype=np.uint64)
            for i in range(m):
                x = _fold(x, h[lo + i : lo + i + 1])
            out.append(x)
    return out


def _fold(x: np.ndarray, word: np.ndarray) -> np.ndarray:
    x = (x ^ word) * _MUL
    return x ^ (x >> np.uint64(29))


def frequent(docs: DataFrame) -> np.ndarray:
    """Rank of each cell in the global order: 0, or the place among the frequent ones, rarest first. Counted over all
    documents; at most FREQUENT rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, n = np.zeros(1 << CELL, dtype=np.int64), 0
        for b in batches:
            n += b.num_rows
            for some in text_groups(b, 1, PART):
                hit, times = np.unique(np.concatenate(shingles(some.column(1).to_pylist())) >> np.uint64(64 - CELL), return_counts=True)
                cells[hit.astype(np.int64)] += times
        top = np.flatnonzero(cells > max(1, SHARE * n))
        yield pa.record_batch([pa.array(top), pa.array(cells[top])], names=["cell", "n"])

    got = docs.mapInArrow(lean(count), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "cell").limit(FREQUENT).toPandas()
    return got["cell"].to_numpy(np.int64)[::-1]


def ranks(last: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << CELL, dtype=np.int32)
    out[last] = np.arange(1, len(last) + 1)
    return out


def ordered(items: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """items, ascending, in the global order."""
    return items[np.argsort(rank[(items >> np.uint64(64 - CELL)).astype(np.int64)], kind="stable")]


def needed(a: int, b: int, t: tuple[int, int] = THRESHOLD) -> int:
    """Least overlap of two sets of these sizes that link: the least x with den * x >= num * (a + b - x)."""
    num, den = t
    return -(-num * (a + b) // (num + den))


def prefix_length(n: int, t: tuple[int, int] = THRESHOLD) -> int:
    return n - -(-t[0] * n // t[1]) + 1 if n else 0


def _scramble(items: np.ndarray, seed: int) -> np.ndarray:
    x = (items ^ (np.array([seed + 1], dtype=np.uint64) * _MUL)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def bands(items: list[np.ndarray]) -> np.ndarray:
    """The band keys of each (non-empty) set."""
    flat, starts = np.concatenate(items), np.cumsum([0, *map(len, items[:-1])])
    out = np.empty((len(items), BANDS), dtype=np.uint64)
    for b in range(BANDS):
        key = np.full(len(items), b, dtype=np.uint64)
        for r in range(ROWS):
            key = _fold(key, np.minimum.reduceat(_scramble(flat, b * ROWS + r), starts))
        out[:, b] = key
    return out


def bitmap(items: np.ndarray) -> np.ndarray:
    """Parities of the items by cell of the bitmap. The bitmaps of two sets differ in no more bits than the sets in items."""
    bits = max(BITMAP, 1 << int(2 * len(items)).bit_length())
    odd = np.bincount((items % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def bits_apart(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the bitmaps of each pair differ, the larger one folded to the size of the smaller."""
    la, lb = (np.array([len(x) for x in c], dtype=np.int64) for c in (a, b))
    out = np.zeros(len(a), dtype=np.int64)
    for x, y in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == x) & (lb == y))
        m = min(x, y)
        u, v = (np.bitwise_xor.reduce(np.frombuffer(b"".join([c[i] for i in at]), dtype=np.uint8).reshape(len(at), -1, m), axis=1) for c in (a, b))
        out[at] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
    return out


def features(docs: DataFrame, last: np.ndarray) -> DataFrame:
    """id, n (set size), digest of the set, its band keys, its prefix and its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(shared.value)
        for b in batches:
            for some in text_groups(b, 1, PART):
                got = shingles(some.column(1).to_pylist())
                full = [x for x in got if len(x)]
                keys = iter(bands(full).view(np.int64).tolist() if full else [])
                cols = [
                    some.column(0), pa.array([len(x) for x in got], pa.int64()), pa.array([xxhash.xxh128_digest(x.tobytes()) for x in got], pa.binary()),
                    pa.array([next(keys) if len(x) else None for x in got], pa.list_(pa.int64())),
                    pa.array([ordered(x, rank)[: prefix_length(len(x))].view(np.int64) for x in got], pa.list_(pa.int64())),
                    pa.array([bitmap(x).tobytes() for x in got], pa.binary()),
                ]
                yield pa.record_batch(cols, names=["id", "n", "digest", "bands", "prefix", "bitmap"])

    return docs.mapInArrow(lean(run), "id long, n long, digest binary, bands array<long>, prefix array<long>, bitmap binary")


def may_link(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and bitmaps leave room for a link."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.struct("n", "bitmap").alias(f"of_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (na, xa), (nb, xb) = ((c.field(0).to_numpy(), c.field(1).to_pylist()) for c in (b.column("of_a"), b.column("of_b")))
                ok = (na + nb - bits_apart(xa, xb)) // 2 >= -(-THRESHOLD[0] * (na + nb) // sum(THRESHOLD))
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lean(run), "a long, b long").distinct()


def sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """id and items (bytes of the ordered hashes) of the documents with these ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in text_groups(b, 1, PART):
                yield pa.record_batch([some.column(0), pa.array([x.tobytes() for x in shingles(some.column(1).to_pylist())], pa.binary())], names=["id", "items"])

    return docs.join(small(ids, IDS), "id", "left_semi").mapInArrow(lean(run), "id long, items binary")


def trie_join(probe: np.ndarray, partners: list[np.ndarray], t: tuple[int, int] = THRESHOLD, step: int = 64) -> list[int]:
    """Places of the partners that link with probe; all sets ascending.

    Partners in lexicographic order are the leaves of their trie from left to right. stem holds, for the path to the last
    leaf, the overlap with the probe after each node; dead is the depth of the highest node on it whose subtree cannot link
    for any size that a partner below may have.
    """
    order = sorted(range(len(partners)), key=lambda i: partners[i].byteswap().tobytes())
    out: list[int] = []
    last, stem, known = np.empty(0, dtype=np.uint64), np.zeros(1, dtype=np.int64), 0
    for i in order:
        p = partners[i]
        m = min(known, len(p))
        differ = np.flatnonzero(p[:m] != last[:m])
        depth = int(differ[0]) if len(differ) else m
        need = needed(len(probe), len(p), t)
        stem = np.concatenate((stem[: depth + 1], np.zeros(len(p) - depth, dtype=np.int64)))
        at = depth
        while at < len(p):
            seen = int(stem[at])
            # what is left of the probe starts behind the node's n-gram
            behind = len(probe) - (int(np.searchsorted(probe, p[at - 1], side="right")) if at else 0)
            if seen + min(len(p) - at, behind) < need:
                break
            part = p[at : at + step]
            where = np.minimum(np.searchsorted(probe, part), len(probe) - 1)
            stem[at + 1 : at + 1 + len(part)] = seen + np.cumsum(probe[where] == part)
            at += len(part)
        last, known = p, at
        if at == len(p) and stem[at] >= need:
            out.append(i)
    return out


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) that link. Partners of one a are dealt over several tasks where there are many."""
    many = pairs.groupBy("a").agg((F.count("*") / PARTNERS).cast("int").alias("more"))
    pairs = stage(pairs.join(many, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("more") + 1)).select("a", "b", "salt"), "jaccard-salted")
    ids = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    held = stage(sets(docs, ids), "jaccard-sets")
    probes = pairs.select("a", "salt").distinct().join(held.withColumnRenamed("id", "a"), "a").select("a", "salt", F.lit(-1).cast("long").alias("b"), F.lit(0).alias("partner"), "items")
    partners = pairs.join(held.withColumnRenamed("id", "b"), "b").select("a", "salt", "b", F.lit(1).alias("partner"), "items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, probe, names, waiting, a_out, b_out, held = None, [], [], [], [], [], 0

        def work():
            for q in probe:
                for i in trie_join(q, waiting):
                    a_out.append(key[0])
                    b_out.append(names[i])
            names.clear()
            waiting.clear()

        for b in batches:
            for a, salt, other, partner, items in zip(*(c.to_pylist() for c in b.columns)):
                if (a, salt) != key:
                    work()
                    key, probe, held = (a, salt), [], 0
                x = np.frombuffer(items, dtype=np.uint64)
                if partner:
                    names.append(other)
                    waiting.append(x)
                    held += len(items)
                    if len(waiting) >= PARTNERS or held > HELD:
                        work()
                        held = 0
                else:
                    probe.append(x)
            if len(a_out) > 10_000:
                yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])
                a_out, b_out = [], []
        work()
        yield pa.record_batch([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = probes.unionByName(partners).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "partner")
    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def components(links: DataFrame) -> DataFrame:
    """id and label (the smallest id reachable) of every id in links (a, b)."""
    edges = stage(links.select("a", "b").union(links.select("b", "a")).distinct(), "jaccard-edges")
    label = stage(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "jaccard-labels")
    while True:
        near = edges.join(label, edges.b == label.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        new = stage(label.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("old")), "jaccard-near")
        up = new.select(F.col("id").alias("label"), F.col("label").alias("top"))
        new = stage(new.join(up, "label").select("id", F.col("top").alias("label"), (F.col("top") != F.col("old")).alias("moved")), "jaccard-labels")
        label = new.select("id", "label")
        if not new.filter("moved").take(1):
            return label


def hot_grams(nodes: DataFrame) -> DataFrame:
    """The prefix n-grams that over BLOCK nodes hold, and into how many blocks each is split. Partitions count first, in
    stretches of FLUSH n-grams and over; what one stretch has once only is left out, so that a group may be larger than it
    counts here by one for each stretch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            g, times = np.unique(np.concatenate(held), return_counts=True)
            return pa.record_batch([pa.array(g[times > 1]), pa.array(times[times > 1])], names=["g", "c"])

        for b in batches:
            held.append(b.column(0).flatten().to_numpy())
            n += len(held[-1])
            if n >= 10 * FLUSH:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    counts = nodes.select("prefix").mapInArrow(lean(count), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    return counts.filter(F.col("c") > BLOCK).select("g", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))


def group_pairs(g: np.ndarray, side: np.ndarray, n: np.ndarray, pos: np.ndarray, ids: np.ndarray, label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs within each group of rows with one g, which stand together. Rows of sides 1 and 2 meet the other
    side only."""
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    size = np.diff(np.append(start, len(g)))
    several = np.repeat(np.minimum.reduceat(label, start) != np.maximum.reduceat(label, start), size)
    if not several.any():
        return
    group = np.repeat(np.arange(len(start)), size)[several]
    n, pos, ids, label, side = (x[several] for x in (n, pos, ids, label, side))
    order = np.lexsort((n, group))
    group, n, pos, ids, label, side = (x[order] for x in (group, n, pos, ids, label, side))
    left = n - pos  # the n-gram and what lies behind it
    num, den = THRESHOLD

    def may(i, j):
        need = -(-num * (n[i] + n[j]) // (num + den))
        return (label[i] != label[j]) & ((side[i] == 0) | (side[i] != side[j])) & (np.minimum(left[i], left[j]) >= need)

    first, size = np.unique(group, return_index=True, return_counts=True)[1:]
    large = size > 256
    for lo, m in zip(first[large].tolist(), size[large].tolist()):
        # rows of the commonest label meet the others only, which are taken some at a time
        rows = np.arange(lo, lo + m)
        names, place, times = np.unique(label[rows], return_inverse=True, return_counts=True)
        common = place == times.argmax()
        for part in np.array_split(rows[~common], -(-int((~common).sum()) // 256)):
            i, j = part[:, None], rows[None, :]
            a, b = np.nonzero(may(i, j) & (common[None, :] | (i < j)))
            yield ids[part[a]], ids[rows[b]]
    i, d = np.flatnonzero(np.repeat(~large, size)), 1
    while len(i):
        # the partner d places behind: of the same group, and no larger than may link
        i = i[i + d < len(group)]
        i = i[(group[i + d] == group[i]) & (num * n[i + d] <= den * n[i])]
        at = i[may(i, i + d)]
        if len(at):
            yield ids[at], ids[at + d]
        d += 1


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The columns of batches, which begin with g and cell, in stretches that end where a group ends: a list of NumPy arrays,
    or of Python lists where a column is binary."""

    def columns(b):
        return [c.to_pylist() if pa.types.is_binary(c.type) else c.to_numpy() for c in b.columns]

    def joined(held):
        return [np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for c in zip(*held)]

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(columns(batch))
        n += batch.num_rows
        if n >= FLUSH:
            cols = joined(held)
            # the last group waits for the rest of its rows
            end = int(np.argmax((cols[0] == cols[0][-1]) & (cols[1] >> 2 == cols[1][-1] >> 2)))
            if end:
                yield [c[:end] for c in cols]
            held, n = [[c[end:] for c in cols]], 0
    if held:
        yield joined(held)


def _group_key(g: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], (g[1:] != g[:-1]) | (cell[1:] >> 2 != cell[:-1] >> 2))))


def prefix_members(nodes: DataFrame) -> DataFrame:
    """Rows (g, cell, id, label, at) of nodes (id, label, n, prefix) with at least one candidate partner in the group of a
    prefix n-gram: not connected, and with positions that leave room for a link with nothing shared before. A group gives each
    of its members once at most, however many pairs they form."""
    rows = nodes.select("id", "label", "n", F.posexplode("prefix").alias("pos", "g"))
    hot = stage(hot_grams(nodes), "jaccard-hot")
    cell = F.lit(0).cast("long")
    if hot.take(1):
        # block x meets every block y: the cell of both, and on which side of it the row stands
        rows = rows.join(small(hot), "g", "left").withColumn("x", F.coalesce(F.pmod(F.xxhash64("id"), F.col("blocks")), F.lit(0)))
        rows = rows.withColumn("y", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
        side = F.when(F.col("x") == F.col("y"), 0).when(F.col("x") < F.col("y"), 1).otherwise(2)
        cell = (F.least("x", "y").cast("long") * F.coalesce("blocks", F.lit(1)) + F.greatest("x", "y")) * 4 + side
    rows = rows.select("g", cell.alias("cell"), "id", "label", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _groups(batches):
            g, cell, _, label, at = cols
            partner = np.zeros(len(g), dtype=bool)
            for i, j in group_pairs(_group_key(g, cell), cell & 3, at >> 32, at & 0xFFFFFFFF, np.arange(len(g)), label):
                partner[i] = partner[j] = True
            yield pa.record_batch([pa.array(c[partner]) for c in cols], names=["g", "cell", "id", "label", "at"])

    return dealt(rows).mapInArrow(lean(run), "g long, cell long, id long, label long, at long")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by group, the blocks of a hot one apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, F.col("g"), F.shiftright("cell", 2)).sortWithinPartitions("g", F.shiftright("cell", 2))


class Bitmaps:
    """The bitmaps of some rows, by length, for comparison pair by pair."""

    def __init__(self, maps: list[bytes]):
        self.lens = np.array([len(m) for m in maps], dtype=np.int64)
        self.place, self.tables = np.zeros(len(maps), dtype=np.int64), {}
        for n in np.unique(self.lens).tolist():
            rows = np.flatnonzero(self.lens == n)
            self.place[rows] = np.arange(len(rows))
            self.tables[n] = np.frombuffer(b"".join([maps[i] for i in rows]), dtype=np.uint8).reshape(len(rows), n)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many bits the bitmaps of rows i and j differ, the larger one folded to the size of the smaller."""
        out = np.zeros(len(i), dtype=np.int64)
        for x, y in set(zip(self.lens[i].tolist(), self.lens[j].tolist())):
            at = np.flatnonzero((self.lens[i] == x) & (self.lens[j] == y))
            u, v = (np.bitwise_xor.reduce(self.tables[n][self.place[r[at]]].reshape(len(at), -1, min(x, y)), axis=1) for n, r in ((x, i), (y, j)))
            out[at] = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
        return out


def prefix_pairs(nodes: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of nodes: they share a prefix n-gram, are not connected, and neither its positions nor their
    bitmaps (id, bitmap) exclude a link. Pairs are compared where the group stands; only those that stay leave the task."""
    members = stage(prefix_members(nodes), "jaccard-members")
    forget(nodes)
    rows = dealt(members.join(bitmaps.select("id", "bitmap"), "id").select("g", "cell", "id", "label", "at", "bitmap"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        num, den = THRESHOLD
        for g, cell, ids, label, at, maps in _groups(batches):
            n, held = at >> 32, Bitmaps(maps)
            for i, j in group_pairs(_group_key(g, cell), cell & 3, n, at & 0xFFFFFFFF, np.arange(len(g)), label):
                for lo in range(0, len(i), COMPARED):
                    a, b = i[lo : lo + COMPARED], j[lo : lo + COMPARED]
                    both = n[a] + n[b]
                    ok = ((both - held.apart(a, b)) // 2 >= -(-num * both // (num + den))) & (ids[a] != ids[b])
                    a, b = ids[a[ok]], ids[b[ok]]
                    if len(a):
                        yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return rows.mapInArrow(lean(run), "a long, b long").distinct()


def forget(df: DataFrame) -> None:
    """Have the driver collect its garbage: the shuffle files of plans whose results are written go with the plans."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n and component of every row."""
    own = F.col(id_col).cast("long")
    nameless = F.lit(NAMELESS) + F.pmod(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(NAMELESS))
    known = docs.select(F.coalesce(own, nameless).alias("id"), F.col(text_col).alias("text"))
    all_ = stage(features(known, frequent(known)), "jaccard-features")
    full = all_.filter("n > 0")
    first = stage(full.groupBy("digest").agg(F.min("id").alias("rep")), "jaccard-sets-once")
    reps = full.join(first, (full.digest == first.digest) & (full.id == first.rep), "left_semi").dropDuplicates(["id", "digest"])
    keys = reps.select("id", F.explode("bands").alias("band"))
    hub = keys.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("z")).filter("a < z").drop("z")
    stars = stage(keys.join(hub, "band").filter("a < id").select("a", F.col("id").alias("b")).distinct(), "jaccard-stars")
    once = stage(reps.select("id", "n", "bitmap"), "jaccard-bitmaps")
    links = stage(verify(known, stage(may_link(stars, once), "jaccard-stars")), "jaccard-links")
    label = components(links)
    forget(docs)
    nodes = reps.select("id", "n", "prefix").join(label, "id", "left").withColumn("label", F.coalesce("label", "id"))
    more = stage(prefix_pairs(nodes, once), "jaccard-pairs")
    forget(docs)
    links = links.union(stage(verify(known, more), "jaccard-links"))
    # copies meet in their representatives, and so do the texts of rows that share an id
    of = full.select("id", "digest").join(first, "digest").select("id", "rep")
    shared = of.groupBy("id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).filter("a < b").select("id", "a")
    links = links.union(of.join(shared, "id").filter("a < rep").select("a", F.col("rep").alias("b")))
    label = components(links)
    of = of.join(label.select(F.col("id").alias("rep"), "label"), "rep", "left")
    label = of.groupBy("id").agg(F.min(F.coalesce("label", "rep")).alias("label"))
    named = lambda c: F.when(c < NAMELESS, c)
    return all_.select("id", "n").join(label, "id", "left").select(named(F.col("id")).alias("id"), "n", named(F.coalesce("label", "id")).alias("component"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component: of the smallest id, a null one coming last, then of the smallest text hash.
    Different texts that share an id are documents of their own here, and so are those without one; of rows equal in id and
    text one stays. Rows without words go only where id and text repeat."""
    known = (F.col(id_col).cast("long"), F.xxhash64(F.coalesce(text_col, F.lit(""))))
    odd = docs.groupBy(known[0].alias("id")).agg(F.count("*").alias("n")).filter("n > 1 or id is null").take(1)
    if odd:
        # numbers in the order of survival; written, so that they stay the same
        numbers = docs.select(known[0].alias("__id"), known[1].alias("__digest")).distinct().orderBy(F.col("__id").asc_nulls_last(), "__digest")
        numbers = stage(numbers.withColumn("__key", F.monotonically_increasing_id()), "jaccard-numbers")
        own = docs.withColumn("__own", known[0]).withColumn("__hash", known[1])
        own = own.join(numbers, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__hash") == F.col("__digest")))
        same = Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns))
        own = own.withColumn("__turn", F.row_number().over(same)).filter("__turn = 1")
        docs_, key = stage(own.select("__key", *docs.columns), "jaccard-numbered"), "__key"
    else:
        docs_, key = docs, id_col
    found = link(docs_, key, text_col)
    gone = stage(found.filter("id <> component").select(F.col("id").alias(key)).distinct(), "jaccard-gone")
    return docs_.join(small(gone, IDS), key, "left_anti").select(docs.columns)
