"""Best-fit packing of documents into sequences.

Documents are cut into pieces of at most CAPACITY tokens. Pieces of one length are interchangeable, so a plan is made from
the number of pieces of each length alone, which has CAPACITY entries however many documents there are: pieces above a
third of the capacity are matched greedily, each with the largest partner that still fits, at most two in a sequence;
smaller pieces, from the longest down, go where the gap that stays is smallest. The plan is a list of runs (so many pieces
of a length from a given rank on go to so many sequences from a given number on, at one offset); pieces then find their run
by their rank within their length. Ranks come from counts by partition and length, so no length is gathered in one task.

Nulls: a null text has the closing id alone. Repeated rows are packed each. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small, stage, text_groups

CAPACITY, CLOSING = 4096, 1
#: Words and pieces of words whose ids a worker keeps, bytes of text encoded together, and what stands between words that are.
CACHE, GROUP, MARK = 100_000, 1 << 20, "\x01"
_piece = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")
_END = CLOSING.to_bytes(4, "little")
#: The printable characters that stand for bytes in byte-level vocabularies: those of Latin-1 for themselves, the rest in
#: order from U+0100.
_printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 0x100 + i for i, b in enumerate(x for x in range(256) if x not in _printable)}


class Encoder:
    """ids of texts, word by word: the tokenizer never joins symbols over white space, so a word's ids are its own. The
    words of a group of texts are told apart in Arrow; each distinct one is encoded once, and its ids are gathered for all
    its places. tokenizer: a file's path, or the bare name of a public tokenizer, which each worker looks up for itself."""

    def __init__(self, tokenizer: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads only add memory pools
        from tokenizers import Tokenizer

        if os.path.basename(tokenizer) == tokenizer:
            import public_tokenizers

            tokenizer = public_tokenizers.path(tokenizer)
        self.tokenizer, self.known, self.cores = Tokenizer.from_file(tokenizer), ({}, {}), {}
        self.model = self.tokenizer.model
        self.mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # if the tokenizer takes a word's letters and the signs behind them as two pieces, the model alone can encode them
        tests = ["house", "Housecat", "x", "well,", "zebra!?", "a_", "été", "Größe;"]
        self.plain = all(self.pieces([w])[0] == self.whole([w])[w] for w in tests)

    def whole(self, new: list[str]) -> dict[str, bytes]:
        """Words through the whole tokenizer, some hundred at a time, with a mark between them."""
        alone = [w for w in new if MARK in w] if len(self.mark) == 1 else new
        plain = [w for w in new if MARK not in w] if len(self.mark) == 1 else []
        out = {w: np.array(e.ids, dtype="<u4").tobytes() for w, e in zip(alone, self.tokenizer.encode_batch(alone, add_special_tokens=False))}
        groups = [plain[i : i + 400] for i in range(0, len(plain), 400)]
        for g in groups:
            e = self.tokenizer.encode_batch_fast([f" {MARK} ".join(g)], add_special_tokens=False)[0]
            ids = np.array(e.ids, dtype="<u4")
            ends = np.append(np.flatnonzero(ids == self.mark[0]), len(ids)).tolist()
            raw, at = ids.tobytes(), 0
            for w, end in zip(g, ends, strict=True):
                out[w] = raw[4 * at : 4 * end]
                at = end + 1
        return out

    def pieces(self, words: list[str]) -> list[bytes | None]:
        """ids of words of letters, with or without signs behind them, by the model alone; None for other words."""
        cores, tokenize, match, normal = self.cores, self.model.tokenize, _piece.fullmatch, unicodedata.is_normalized
        out: list[bytes | None] = []
        for word in words:
            m = match(word.lower())
            if not m:
                out.append(None)
                continue
            core, signs = m.groups()
            if not core.isascii():
                if not core.isalpha() or max(core) >= "\u0250" or not normal("NFC", word):
                    out.append(None)
                    continue
                core = core.encode().decode("latin-1").translate(_BYTE_LEVEL)
            ids = b""
            for piece in (core, signs) if signs else (core,):
                got = cores.get(piece)
                if got is None:
                    got = cores[piece] = array("I", [x.id for x in tokenize(piece)]).tobytes()
                ids += got
            out.append(ids)
        if len(cores) > CACHE:
            cores.clear()
        return out

    def words(self, new: list[str]) -> list[bytes]:
        out = self.pieces(new) if self.plain else [None] * len(new)
        rest = self.whole([w for w, ids in zip(new, out) if ids is None])
        return [rest[w] if ids is None else ids for w, ids in zip(new, out)]

    def __call__(self, texts: pa.Array) -> tuple[bytes, np.ndarray]:
        """ids of all texts, one behind the other, as bytes, and where each text's ids begin and the last one's end."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        place, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        # words are kept in two generations: the older one goes when the younger is full
        young, old = self.known
        found = list(map(young.get, distinct))
        missing = [i for i, x in enumerate(found) if x is None]
        names = [distinct[i] for i in missing]
        ids = list(map(old.get, names))
        new = [i for i, x in enumerate(ids) if x is None]
        for i, x in zip(new, self.words([names[i] for i in new])):
            ids[i] = x
        for i, x in zip(missing, ids):
            found[i] = x
        young.update(zip(names, ids))
        if len(young) > CACHE:
            self.known = {}, young
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ends = np.concatenate(([0], np.cumsum(size[place])))[bounds]
        return b"".join(map(found.__getitem__, place.tolist())), ends


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, and the piece's rank among those of its length in this partition."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = Encoder(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for some in text_groups(batch, 1, GROUP):
                rows = []
                raw, bounds = encode(some.column(1))
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    n = hi - lo + 1  # the closing id is not in raw
                    for piece, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        crc = zlib.crc32(raw[4 * (lo + start) : 4 * min(lo + start + length, hi)])
                        crc = zlib.crc32(_END, crc) if start + length == n else crc
                        rows.append((i, piece, start, length, crc, part, ranks[length]))
                        ranks[length] += 1
                cols = [pa.array(c, k) for c, k in zip(zip(*rows), [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()])]
                yield pa.record_batch([some.column(0).take(cols[0]), *cols[1:]], names=["id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lean(cut), f"id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first sequence, offset) for the number of pieces of each length."""
    left, used, runs, fresh = dict(counts), defaultdict(int), [], 0
    gaps: dict[int, list] = defaultdict(list)  # by gap: runs of sequences, as first and number
    order: list[int] = []  # the gaps there are, ascending

    def put(length: int, number: int, first: int, offset: int) -> None:
        runs.append((length, used[length], number, first, offset))
        used[length] += number
        left[length] -= number

    def opened(first: int, number: int, gap: int) -> None:
        if gap:
            if not gaps[gap]:
                bisect.insort(order, gap)
            gaps[gap].append((first, number))

    third = capacity // 3
    large = sorted(n for n in counts if n > third)
    for a in reversed(large):
        while left[a] > 0:
            at = bisect.bisect_right(large, min(capacity - a, a)) - 1
            while at >= 0 and (left[large[at]] == 0 or (large[at] == a and left[a] < 2)):
                at -= 1
            if at < 0:
                n = left[a]
                put(a, n, fresh, 0)
                opened(fresh, n, capacity - a)
            else:
                b = large[at]
                n = left[a] // 2 if a == b else min(left[a], left[b])
                put(a, n, fresh, 0)
                put(b, n, fresh, a)
                opened(fresh, n, capacity - a - b)
            fresh += n
    for s in sorted((n for n in counts if n <= third), reverse=True):
        while left[s] > 0:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                per = capacity // s
                n = max(1, left[s] // per)
                for k in range(min(per, left[s])):
                    put(s, n, fresh, k * s)
                    k += 1
                opened(fresh, n, capacity - k * s)
                fresh += n
                continue
            gap = order[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                order.pop(at)
            n = min(number, left[s])
            if n < number:
                opened(first + n, number - n, gap)
            put(s, n, first, capacity - gap)
            opened(first, n, gap - s)
    return runs


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id and offset of each piece."""
    cut = stage(pieces(docs, tokenizer, id_col, text_col, capacity), "pack-pieces")
    each = cut.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    base = stage(each.withColumn("base", base), "pack-counts")
    counts = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    runs = np.array(sorted(plan(counts, capacity)), dtype=np.int64).reshape(-1, 5)
    key = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
                run = runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
                yield pa.record_batch([*b.columns[:5], pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])], names=[*b.schema.names[:5], "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    ranked = cut.join(small(base.drop("n")), ["length", "part"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank"))
    return ranked.mapInArrow(lean(place), f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
