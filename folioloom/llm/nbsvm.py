"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A text's features are the distinct hashed n-grams (one and two tokens) of its whole text. A token is a run of letters and
digits or a run of other visible characters; a token equal to the one before stands as one symbol for all repetitions.
Indicators are scaled by the log-count ratios of the two classes and by the text's norm; a linear hinge-loss model over
them is fitted by dual coordinate descent, and its weights are drawn towards their mean size (INTERPOLATE).

What is learned from: labels are joined to documents by id, and ids are dealt into FOLDS by the crc32 of their decimal
form. Fold 0 is held out. Fold 1 calibrates: all its margins, counted by class in bins, give the two numbers of a logistic
curve from margins to scores. The others give the log-count ratios, over all their documents, and the linear model, over a
bounded sample: SAMPLE documents, found among the twice as many whose ids hash lowest, with at most GRAMS distinct n-grams.
No other part has a bound.

Nulls and empties: a null or empty text has no features, and the score of the model's bias; a null id or label is not
learned from; labels other than 0 and 1, and ids whose labels differ, neither. Repeated rows get the same score. Without
both classes every score is the share of class 1 among the labels (smoothed by one of each). An empty table gives an empty
result. Texts are read in stretches of about a megabyte, a longer one alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, small, stage, text_groups
from .repeats import Hashes, mix

BITS, FOLDS = 20, 5
SAMPLE, GRAMS = 10_000, 1 << 13
#: Smoothing of the log-count ratios, cost of a violated margin, share of a weight that is its own, and sweeps.
ALPHA, COST, INTERPOLATE, SWEEPS = 1.0, 1.0, 0.25, 20
#: Bins of margins between -RANGE and RANGE.
BINS, RANGE = 400, 8.0
#: Labels that may be broadcast to the texts; more are joined by a shuffle.
LABELS = 1_000_000
PART = 1 << 19
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_BYTES = np.random.default_rng(17).integers(0, 2**64, 256, dtype=np.uint64)
_SAME = np.uint64(0x2545F4914F6CDD1D)


def ngrams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text's distinct n-grams, ascending, text after text, and how many each text has."""
    raw = [t or b"" for t in texts]
    buffer = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    kind = _CLASS[buffer]
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1]))) if len(buffer) else np.empty(0, dtype=np.int64)
    ends = np.append(edge[1:], len(buffer))
    full = kind[edge] > 0
    begin, end = edge[full], ends[full]
    if not len(begin):
        return np.empty(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    h = Hashes(_BYTES[buffer])(begin, end)
    of = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), begin, side="right")
    with_next = of[1:] == of[:-1]
    same = np.concatenate(([False], (h[1:] == h[:-1]) & with_next))
    h = np.where(same, _SAME, h)
    two = mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ (h[1:] >> np.uint64(1)))[with_next]
    keys = np.concatenate((mix(h) >> np.uint64(64 - BITS), two >> np.uint64(64 - BITS))).astype(np.int64)
    keys = np.sort(np.concatenate((of, of[:-1][with_next])).astype(np.int64) << BITS | keys)
    keys = keys[np.concatenate(([True], keys[1:] != keys[:-1]))]
    return keys & ((1 << BITS) - 1), np.bincount(keys >> BITS, minlength=len(texts))


def log_ratios(pos: np.ndarray, neg: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
    """The log-count ratio of each bucket; 0 for those that no document has."""
    p, q = pos + alpha, neg + alpha
    return np.where(pos + neg > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0.0)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = COST, sweeps: int = SWEEPS, tolerance: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model over rows of buckets scaled by r and each row's norm. Dual coordinate
    descent: each turn solves the dual for one row's multiplier exactly, and the weights follow. The bias is the weight of
    a feature that every row has. Classes count the same in sum."""
    w, bias = np.zeros(len(r)), 0.0
    size = np.array([np.linalg.norm(r[i]) for i in rows])
    q = np.where(size > 0, 2.0, 1.0)  # the squared norm of a row with the bias's feature
    size[size == 0] = 1.0
    top = cost * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    a, order = np.zeros(len(y)), np.random.default_rng(3)
    for _ in range(sweeps):
        moved = 0.0
        for k in order.permutation(len(y)):
            i, v = rows[k], r[rows[k]] / size[k]
            slope = y[k] * (w[i] @ v + bias) - 1
            new = min(max(a[k] - slope / q[k], 0.0), top[k])
            if new != a[k]:
                d = (new - a[k]) * y[k]
                moved = max(moved, abs(d))
                w[i] += d * v
                bias += d
                a[k] = new
        if moved < tolerance:
            break
    return w, bias


@dataclass
class Model:
    """What scores a text: value of each bucket (ratio and weight together), squared ratios for the norm, and the bias."""

    value: np.ndarray
    square: np.ndarray
    bias: float

    def margins(self, texts: list[bytes | None]) -> np.ndarray:
        at, n = ngrams(texts)
        of = np.repeat(np.arange(len(n)), n)
        norm = np.sqrt(np.bincount(of, weights=self.square[at], minlength=len(n)))
        return np.bincount(of, weights=self.value[at], minlength=len(n)) / np.where(norm > 0, norm, 1.0) + self.bias


def model_of(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, interpolate: float = INTERPOLATE) -> Model:
    """The fitted model. A weight is drawn towards the mean size of all, that is, towards naive Bayes."""
    w, bias = descend(rows, y, r)
    w = np.where(w != 0, (1 - interpolate) * np.abs(w).sum() / max(1, (w != 0).sum()) + interpolate * w, 0.0)
    return Model((w * r).astype(np.float32), (r * r).astype(np.float32), float(bias))


def platt(pos: np.ndarray, neg: np.ndarray, at: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over margins at, of which pos and neg were seen in each class: most likely
    under targets drawn in by one observation of the other class, found by Newton's method with step halving."""
    n1, n0 = pos.sum(), neg.sum()
    high, low = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    want, n = pos * high + neg * low, pos + neg
    design = np.stack([at, np.ones_like(at)])

    def loss(t):
        z = t @ design
        return (n * np.logaddexp(0, z) - want * z).sum() + 1e-6 * (t @ t)

    t = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(t @ design, -500, 500)))
        slope = design @ (n * p - want) + 2e-6 * t
        step = np.linalg.solve((design * (n * p * (1 - p))) @ design.T + 2e-6 * np.eye(2), slope)
        scale = 1.0
        while loss(t - scale * step) > loss(t) and scale > 1e-8:
            scale /= 2
        t = t - scale * step
        if np.abs(scale * step).max() < 1e-9:
            break
    return float(max(t[0], 0.0)), float(t[1])


def fold_of(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string")) % FOLDS


def targets(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """__id and __y (0 or 1), once an id, of the labels that may be learned from."""
    y = F.col(label_col).cast("int")
    good = labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1) & (fold_of(F.col(id_col)) > 0))
    one = good.groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.min(y).alias("__y"), F.max(y).alias("__z"))
    return one.filter("__y = __z").select("__id", "__y")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class that have each bucket, summed over the task."""
    held = np.zeros((2, 1 << BITS), dtype=np.int64)
    for b in batches:
        for some in text_groups(b, 0, PART):
            at, n = ngrams(some.column(0).to_pylist())
            y = np.repeat(some.column(1).to_numpy(), n)
            for k in (0, 1):
                held[k] += np.bincount(at[y == k], minlength=1 << BITS)
    seen = np.flatnonzero(held.any(axis=0))
    yield pa.record_batch([pa.array(seen), pa.array(held[1, seen]), pa.array(held[0, seen])], names=["bucket", "pos", "neg"])


def _indicators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for some in text_groups(b, 0, PART):
            at, n = ngrams(some.column(0).to_pylist())
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32))
            yield pa.record_batch([some.column(1), some.column(2), pa.ListArray.from_arrays(offsets, pa.array(at.astype(np.int32)))], names=["__y", "__h", "at"])


def fit(texts: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> tuple[Model | None, np.ndarray]:
    """The model without its curve, and the numbers of learned rows by class (0 and 1). texts: __text (binary), __y and __h
    (hash of the id) of the rows to learn from. The counts that reach the driver have a row a bucket at most; the sample is
    bounded by its two parameters, and fitted in one task."""
    counts = texts.select("__text", "__y").mapInArrow(lean(_counts), "bucket long, pos long, neg long").groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    of = texts.groupBy("__y").count().toPandas().set_index("__y")["count"]
    n = np.array([of.get(0, 0), of.get(1, 0)])
    if not n.all():
        return None, n
    pos, neg = np.zeros(1 << BITS), np.zeros(1 << BITS)
    at = counts["bucket"].to_numpy()
    pos[at], neg[at] = counts["pos"].to_numpy(), counts["neg"].to_numpy()
    shared = texts.sparkSession.sparkContext.broadcast(log_ratios(pos, neg))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y = [], []
        for b in batches:
            y += b.column(0).to_pylist()
            rows += [x.values.to_numpy() for x in b.column(1)]
        if not rows or len(set(y)) < 2:
            return
        m = model_of(rows, np.where(np.array(y) > 0, 1, -1), shared.value)
        yield pa.record_batch([pa.array([m.value.tobytes()], pa.binary()), pa.array([m.square.tobytes()], pa.binary()), pa.array([m.bias])], names=["value", "square", "bias"])

    # twice as many are read as are taken, for those with too many n-grams
    upto = texts.select("__h").orderBy("__h").limit(2 * sample).agg(F.max("__h")).first()[0]
    chosen = texts.filter(F.col("__h") <= upto).select("__text", "__y", "__h").mapInArrow(lean(_indicators), "__y int, __h long, at array<int>").filter(F.size("at") <= grams).orderBy("__h", "__y", "at").limit(sample)
    got = stage(chosen, "nbsvm-sample").coalesce(1).sortWithinPartitions("__h", "__y", "at").select("__y", "at").mapInArrow(lean(train), "value binary, square binary, bias double").collect()
    if not got:
        return None, n
    return Model(np.frombuffer(got[0].value, dtype=np.float32), np.frombuffer(got[0].square, dtype=np.float32), got[0].bias), n


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id",
    sample: int = SAMPLE, names: tuple = ("score",),
) -> DataFrame:
    """The id of every row of docs and its score, the chance of class 1."""
    spark = docs.sparkSession
    known = stage(targets(labels, label_id, label_col), "nbsvm-labels")
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("binary").alias("__text"))
    told = slim.filter(fold_of(F.col("__id")) > 1).join(small(known, LABELS), "__id").select("__text", "__y", F.xxhash64("__id").alias("__h"))
    model, n = fit(told, sample)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in text_groups(b, 1, PART):
                m = np.zeros(some.num_rows) if shared.value is None else shared.value.margins(some.column(1).to_pylist())
                yield pa.record_batch([some.column(0), pa.array(m)], names=["id", "margin"])

    scored = stage(slim.mapInArrow(lean(run), "id long, margin double"), "nbsvm-margins")
    own = scored.filter(fold_of(F.col("id")) == 1).join(small(known, LABELS), F.col("id") == F.col("__id"))
    place = F.floor((F.least(F.greatest(F.col("margin"), F.lit(-RANGE)), F.lit(RANGE)) + RANGE) * (BINS / (2 * RANGE)))
    seen = own.groupBy(F.least(place, F.lit(BINS - 1)).cast("int").alias("bin"), "__y").count().toPandas()
    pos, neg = (np.bincount(seen.loc[seen["__y"] == k, "bin"], weights=seen.loc[seen["__y"] == k, "count"], minlength=BINS) for k in (1, 0))
    if model is None:
        n = n + np.array([neg.sum(), pos.sum()])
        value = F.lit(float((n[1] + 1) / (n.sum() + 2)))
    else:
        a, b = platt(pos, neg, (np.arange(BINS) + 0.5) * (2 * RANGE / BINS) - RANGE)
        value = 1 / (1 + F.exp(-F.least(F.greatest(F.col("margin") * a + b, F.lit(-500.0)), F.lit(500.0))))
    return scored.select("id", value.alias(names[0]))
