"""Language identification by character language models with interpolated Kneser-Ney smoothing.

Training reads at most SAMPLE documents a language, those whose id hashes lowest: a documented bound on labelled rows, for
the classifier only. Every model keeps, for each order, sorted arrays of n-gram hashes with their smoothed probabilities
and of context hashes with their back-off weights. A text gets the language with the lowest cross-entropy a character; the
models share one lookup for each distinct n-gram of a batch. Texts are compared lower-cased, with digits as one symbol
and white space as another.

A text that is null or without a letter is "und". A text is rejected if its cross-entropy lies beyond the limit of its
language for texts of its length. Limits come from all labelled documents outside the training sample whose id's crc32 is
not 2 modulo 4 (that fold is held out): in each band of lengths (powers of two) the median of their cross-entropies under
their own language's model and SPREAD times the distance between median and lower quartile, at least MARGIN bits above the
median. Junk lies above the median, so that a few such texts don't move a limit. Training takes no document whose crc32 is
3 modulo 4, so that small languages have some for their limits. A band with fewer than MIN_DOCS of them takes the limit of
the next shorter one (the shortest that of the next longer one); a language without any such band rejects nothing.

Nulls: null languages and null ids are not learned from; repeated rows get the same answer; without any labelled document
every text is "und".
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, small, stage

UNKNOWN = "und"
ORDER = 4
SAMPLE = 200
MIN_COUNT = 2
#: Documents that a limit needs, and limits above the median of cross-entropies.
MIN_DOCS, SPREAD, MARGIN = 20, 6, 0.6
_MUL = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 18


def symbols(text: str) -> np.ndarray:
    """Code points of a text, lower-cased; white space and digits are one symbol each, runs of white space too."""
    a = np.frombuffer(text.lower().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    a[((a >= 9) & (a <= 13)) | (a == 160)] = 32
    a[(a >= 48) & (a <= 57)] = 48
    space = a == 32
    return a[~(space & np.concatenate(([False], space[:-1])))] if len(a) else a


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _MUL
    return h ^ (h >> np.uint64(29))


def grams(a: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hash of the n symbols that end at each position, for n from 0 to order. a begins with order - 1 boundary symbols,
    and the results start behind them."""
    n = len(a) - order + 1
    out = [np.zeros(n, dtype=np.uint64)]
    for k in range(1, order + 1):  # from the last symbol to the left, so that a shorter gram is a step of a longer one
        out.append(_mix(out[-1] * np.uint64(31) + a[order - k : order - k + n] + np.uint64(1)))
    return out


def contexts(a: np.ndarray, order: int = ORDER) -> list[np.ndarray]:
    """Hash of the n - 1 symbols before each position, for n from 1 to order."""
    n = len(a) - order + 1
    out = [np.zeros(n, dtype=np.uint64)]
    for k in range(2, order + 1):
        out.append(_mix(out[-1] * np.uint64(31) + a[order - k : order - k + n] + np.uint64(1)))
    return out


def padded(texts: list[np.ndarray], order: int = ORDER) -> np.ndarray:
    pad = np.full(order - 1, 32, dtype=np.uint64)
    return np.concatenate([x for t in texts for x in (pad, t)]) if texts else pad


def train(texts: list[str], order: int = ORDER) -> dict:
    """Sorted hash arrays of one language. For each order: grams, their probabilities, contexts, their back-off weights."""
    g: list = [[] for _ in range(order + 1)]
    c: list = [[] for _ in range(order + 1)]
    for t in texts:
        if len(s := symbols(t)):
            a = padded([s], order)
            for k, x in enumerate(grams(a, order)):
                g[k].append(x)
            for k, x in enumerate(contexts(a, order)):
                c[k + 1].append(x)
    if not g[order]:
        return {}
    g, c = [np.concatenate(x) if x else None for x in g], [np.concatenate(x) if x else None for x in c]
    model, lower_p = {"orders": []}, None
    # distinct full grams with the hashes of their shorter endings and of their contexts
    for k in range(1, order + 1):
        keys, first, count = np.unique(g[k], return_index=True, return_counts=True)
        if k < order:  # continuation counts: distinct symbols to the left
            longer, at = np.unique(g[k + 1], return_index=True)
            keys, count = np.unique(g[k][at], return_counts=True)
            _, first = np.unique(g[k], return_index=True)
        ctx = c[k][first]
        cu, inv = np.unique(ctx, return_inverse=True)
        total, types = np.bincount(inv, weights=count), np.bincount(inv)
        n1, n2 = int((count == 1).sum()), int((count == 2).sum())
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        gamma = d * types / total
        below = np.full(len(keys), 1 / (len(keys) + 1)) if k == 1 else lower_p(g[k - 1][first])
        p = np.maximum(count - d, 0) / total[inv] + gamma[inv] * below
        model["orders"].append((keys, np.log2(p).astype(np.float32), cu, np.log2(gamma).astype(np.float32)))
        lower_p = lambda x, keys=keys, p=p: p[np.searchsorted(keys, x)]
    model["unseen"] = float(np.log2(np.exp2(model["orders"][0][3][0]) / (len(model["orders"][0][0]) + 1)))
    return model


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return at, keys[at] == x


def log_probabilities(model: dict, g: list[np.ndarray], c: list[np.ndarray]) -> np.ndarray:
    """log2 of the probability of each position's symbol after its context."""
    out, back, todo = np.zeros(len(g[0])), np.zeros(len(g[0])), np.arange(len(g[0]))
    for k in range(len(model["orders"]), 0, -1):
        keys, p, ctx, gamma = model["orders"][k - 1]
        at, hit = _find(keys, g[k][todo])
        out[todo[hit]] = back[todo[hit]] + p[at[hit]]
        todo = todo[~hit]
        at, hit = _find(ctx, c[k - 1][todo])
        back[todo[hit]] += gamma[at[hit]] if k > 1 else 0
    out[todo] = back[todo] + model["unseen"]
    return out


def entropies(models: dict, texts: list[str]) -> np.ndarray:
    """Bits a symbol of each text (rows) under each model (columns); NaN for texts without symbols."""
    seqs = [symbols(t) for t in texts]
    out = np.full((len(texts), len(models)), np.nan)
    begin = 0
    while begin < len(seqs):
        end, n = begin, 0
        while end < len(seqs) and (end == begin or n + len(seqs[end]) < _CHUNK):
            n += len(seqs[end])
            end += 1
        part = [s for s in seqs[begin:end] if len(s)]
        if part:
            a = padded(part)
            g, c = grams(a), contexts(a)
            code, uniq = pd.factorize(g[-1])
            first = np.empty(len(uniq), dtype=np.int64)
            first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
            g1, c1 = [x[first] for x in g], [x[first] for x in c]
            lens = np.array([len(s) for s in part])
            starts = np.cumsum(lens + ORDER - 1) - (lens + ORDER - 1)
            cuts = np.stack([starts, starts + lens], axis=1).ravel()
            rows = begin + np.flatnonzero([len(s) > 0 for s in seqs[begin:end]])
            for j, m in enumerate(models.values()):
                bits = np.concatenate((-log_probabilities(m, g1, c1)[code], np.zeros(ORDER)))
                out[rows, j] = np.add.reduceat(bits, cuts)[::2] / lens
        begin = end
    return out


def sample_ids(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int) -> DataFrame:
    """The ids of at most rows documents a language, of those that are trained on."""
    usable = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.crc32(F.col(id_col).cast("string")) % 4 < 2))
    rank = F.row_number().over(Window.partitionBy(lang_col).orderBy(F.xxhash64(F.col(id_col)), id_col))
    return usable.select(id_col, lang_col).withColumn("__rank", rank).filter(F.col("__rank") <= rows).select(F.col(id_col).alias("__id")).distinct()


def fit(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """The models by language. Each language trains in a task of its own; what comes to the driver is bounded by the
    sample."""
    import pickle
    import zlib

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        model = train(sorted(pdf["text"]))
        if not model:
            return pd.DataFrame({"lang": [], "model": []})
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "model": [zlib.compress(pickle.dumps(model), 1)]})

    labelled = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    texts = labelled.join(F.broadcast(ids), labelled[id_col] == F.col("__id"), "left_semi").select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = texts.groupBy("lang").applyInPandas(one, "lang string, model binary").toPandas().sort_values("lang")
    return {x: pickle.loads(zlib.decompress(m)) for x, m in zip(got["lang"], got["model"])}


def limits(scored: DataFrame, ids: DataFrame) -> DataFrame:
    """__of (language), __low, __high (bands of lengths, from low to below high) and __limit in bits a symbol."""
    known = scored.filter((F.crc32(F.col("__id").cast("string")) % 4 != 2) & F.col("__own").isNotNull()).join(small(ids), "__id", "left_anti")
    band = known.groupBy(F.col("__told").alias("__of"), F.col("__band").alias("__low"))
    found = band.agg(F.count("*").alias("c"), F.percentile_approx("__own", [0.25, 0.5]).alias("q")).filter(F.col("c") >= MIN_DOCS)
    order = Window.partitionBy("__of").orderBy("__low")
    low = F.when(F.row_number().over(order) == 1, 0).otherwise(F.col("__low")).alias("__low")
    limit = F.col("q")[1] + F.greatest(F.lit(MARGIN), SPREAD * (F.col("q")[1] - F.col("q")[0]))
    return found.select("__of", low, F.coalesce(F.lead("__low").over(order), F.lit(64)).alias("__high"), limit.alias("__limit"))


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE,
    keep: list[str] | None = None, names: tuple = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """keep (or the id alone) with the predicted language, a score, and whether the text is rejected, under names. The
    score is the posterior of the language against the next best over a hundred symbols, or the text where that is shorter."""
    ids = stage(sample_ids(docs, id_col, text_col, lang_col, rows), "langid-sample")
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, ids, id_col, text_col, lang_col))
    keep = keep or [id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        langs = np.array([*models, UNKNOWN], dtype=object)
        place = {x: i for i, x in enumerate(models)}
        for b in (x.slice(lo, 500) for x in batches for lo in range(0, x.num_rows, 500)):
            texts = [t if t is not None and any(map(str.isalpha, t)) else "" for t in b.column(b.num_columns - 1).to_pylist()]
            best, score = np.full(len(texts), len(models)), np.zeros(len(texts))
            low, own = np.full(len(texts), np.nan), np.full(len(texts), np.nan)
            if models and texts:
                e = entropies(models, texts)
                ok = np.flatnonzero(~np.isnan(e[:, 0]))
                best[ok] = e[ok].argmin(axis=1)
                low[ok] = e[ok, best[ok]]
                second = np.partition(e[ok], 1, axis=1)[:, 1] if len(models) > 1 else low[ok] + 1
                n = np.minimum(100, [len(texts[i]) for i in ok])
                score[ok] = 1 / (1 + np.exp2(-np.minimum((second - low[ok]) * n, 60)))
                named = np.array([place.get(x, -1) for x in b.column(b.num_columns - 2).to_pylist()])
                own[named >= 0] = e[named >= 0, named[named >= 0]]
            band = pa.array([len(t).bit_length() for t in texts], pa.int32())
            bits = [pa.array(x, from_pandas=True) for x in (low, own)]
            yield pa.record_batch([*b.columns[:-1], pa.array(langs[best].tolist(), pa.string()), pa.array(score), *bits, band], names=out)

    out = [*keep, "__id", "__told", *names[:2], "__bits", "__own", "__band"]
    slim = docs.select(*keep, F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__told"), F.col(text_col).alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.drop("__text").schema)
    scored = stage(slim.mapInArrow(lean(run), f"{kinds}, {names[0]} string, {names[1]} double, __bits double, __own double, __band int"), "langid-scored")
    lim = stage(limits(scored, ids), "langid-limits")
    at = (F.col(names[0]) == F.col("__of")) & (F.col("__band") >= F.col("__low")) & (F.col("__band") < F.col("__high"))
    rejected = F.col("__bits").isNull() | F.coalesce(F.col("__bits") > F.col("__limit"), F.lit(False))
    return scored.join(small(lim), at, "left").withColumn(names[2], rejected).select(*keep, *names)


def accepted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those whose language is unknown or whose text is rejected. Both follow from the text alone, so the texts
    that go are known by their digests, and no text is written."""
    keyed = docs.withColumn("__key", F.md5(F.coalesce(text_col, F.lit(""))))
    found = identify(keyed, id_col, text_col, lang_col, keep=["__key"], names=("__lang", "__score", "__rejected"))
    gone = stage(found.filter((F.col("__lang") == UNKNOWN) | F.col("__rejected")).select("__key").distinct(), "langid-gone")
    return keyed.join(small(gone), "__key", "left_anti").select(docs.columns)
