"""Quality rules: surface counts, and the divergence of a text from language references.

References are built from all documents that name a language: for each language the histogram of character classes, and the
histogram of its TOP most frequent short words (SHORT letters at most), the rest of its words together. A text is measured
by Jensen-Shannon distance against one language for both histograms, the one nearest by the sum of the two, and rejected if
either distance exceeds that language's limit for texts of its length.

Limits come from the distances of all documents that name a language to that language, those that fail the surface counts
aside. For each band of lengths (powers of two, in words) a limit is the median and SPREAD times the distance between
median and lower quartile, at least a margin above the median: junk lies above the median, so that only the half without it
sets the width. A band with fewer than MIN_DOCS documents takes the limit of the next shorter one that has them.

Nulls: a null text has no words; a null language adds nothing to the references. A language has a reference if MIN_DOCS
documents of MIN_WORDS words or more name it; a document that names another language gets no verdict by divergence, and
without any reference nothing is rejected. Repeated rows get the same answer.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lean, small, stage

CLASSES = ("lower", "upper", "other_letter", "mark", "digit", "punctuation", "symbol", "space", "control")
#: Common words of a language, and the letters that such a word may have.
TOP, SHORT = 60, 5
MIN_WORDS, MAX_REPEAT = 50, 50
#: Documents that a reference or a limit needs; limits above the median of distances.
MIN_DOCS, SPREAD, CLASS_MARGIN, WORD_MARGIN = 20, 5, 0.08, 0.05
_SYMBOLS = np.array([ord(c) for c in "#*$%&|<>"], dtype=np.uint32)
_word = re.compile(WORD)
_table: list[np.ndarray] = []


def _class_table() -> np.ndarray:
    """Class number of each code point of the basic plane; letters beyond it count as other letters."""
    if not _table:
        kinds = {"Ll": 0, "Lu": 1, "L": 2, "M": 3, "N": 4, "P": 5, "S": 6, "Z": 7, "C": 8}
        t = np.array([kinds.get(c := unicodedata.category(chr(i)), kinds[c[0]]) for i in range(0x10000)], dtype=np.int64)
        t[[9, 10, 11, 12, 13]] = 7
        _table.append(t)
    return _table[0]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def class_counts(points: np.ndarray) -> np.ndarray:
    t = _class_table()
    return np.bincount(np.where(points < 0x10000, t[np.minimum(points, 0xFFFF)], 2), minlength=len(CLASSES))


def _short(word: str) -> bool:
    return len(word) <= SHORT and word.isalpha()


def _reference_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    classes: dict = {}
    words: dict = {}
    docs: dict = {}
    for b in batches:
        for text, lang in zip(b["text"], b["lang"]):
            if text and lang is not None:
                classes[lang] = classes.get(lang, 0) + class_counts(codes(text))
                found = _word.findall(text.lower())
                words.setdefault(lang, Counter()).update(found)
                docs[lang] = docs.get(lang, 0) + (len(found) >= MIN_WORDS)
        for lang, c in words.items():  # long words are counted together, so that what is kept stays small
            if len(c) > 50_000:
                words[lang] = _shorten(c)
    rows = [(lang, "class", str(i), int(n)) for lang, v in classes.items() for i, n in enumerate(v) if n]
    rows += [(lang, "word", w, n) for lang, c in words.items() for w, n in _shorten(c).items()]
    rows += [(lang, "docs", "", n) for lang, n in docs.items()]
    yield pd.DataFrame(rows, columns=["lang", "kind", "item", "n"])


def _shorten(c: Counter) -> Counter:
    kept = Counter({w: n for w, n in c.items() if _short(w)})
    kept[""] = sum(n for w, n in c.items() if not _short(w))
    return kept


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, kind (class or word), item, n, total: class counts, the TOP words of each language, and at item "" its other
    words. Languages with fewer than MIN_DOCS documents have none."""
    slim = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    n = slim.mapInPandas(_reference_counts, "lang string, kind string, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    n = stage(n, "quality-counts")
    enough = n.filter((F.col("kind") == "docs") & (F.col("n") >= MIN_DOCS)).select("lang")
    n = n.filter("kind <> 'docs'").join(enough, "lang", "left_semi")
    top = F.row_number().over(Window.partitionBy("lang", "kind").orderBy((F.col("item") == "").desc(), F.col("n").desc(), "item"))
    kept = n.withColumn("r", top).filter((F.col("kind") == "class") | (F.col("r") <= TOP + 1)).drop("r")
    total = n.groupBy("lang", "kind").agg(F.sum("n").alias("total"))
    return kept.join(total, ["lang", "kind"])


class References:
    """The histograms of all languages: classes as a matrix, common words by word (where a word's languages begin, how many
    they are, and for each its share), so that memory is that of the histograms themselves."""

    def __init__(self, rows: pd.DataFrame):
        self.langs = sorted(rows.loc[rows.kind == "class", "lang"].unique())
        self.at = {x: i for i, x in enumerate(self.langs)}
        share, lang = (rows.n / rows.total).to_numpy(float), rows.lang.map(self.at).to_numpy(np.int64)
        c, w = (rows.kind == "class").to_numpy(), ((rows.kind == "word") & (rows.item != "")).to_numpy()
        self.cls = np.zeros((len(self.langs), len(CLASSES)))
        self.cls[lang[c], rows.item[c].astype(int)] = share[c]
        code, known = pd.factorize(rows.item[w], sort=True)
        order = np.argsort(code, kind="stable")
        self.col = {x: i for i, x in enumerate(known)}
        self.lang, self.share = lang[w][order], share[w][order]
        self.count = np.bincount(code, minlength=len(known))
        self.begin = np.cumsum(self.count) - self.count
        self.common = np.bincount(self.lang, self.share, len(self.langs))

    def word_distances(self, counts: dict, n: int) -> np.ndarray:
        """Distance of n words with these counts to each language, over its own common words and the others together."""
        held: dict = {}
        for w, k in counts.items():
            if (i := self.col.get(w.lower())) is not None:
                held[i] = held.get(i, 0) + k
        ids = np.fromiter(held, dtype=np.int64, count=len(held))
        times = self.count[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        p, q, lang = np.repeat(np.fromiter(held.values(), dtype=float, count=len(held)) / n, times), self.share[at], self.lang[at]
        total = lambda x: np.bincount(lang, x, len(self.langs))
        # a common word that the text lacks adds its share
        out = total(_divergence(p, q)) + self.common - total(q) + _divergence(np.maximum(1 - total(p), 0), np.maximum(1 - self.common, 0))
        return np.sqrt(np.clip(out / 2, 0, 1))


def collect_references(refs: DataFrame) -> References | None:
    """The references of all languages. At most TOP + 10 rows of each language reach the driver, however many documents."""
    rows = refs.toPandas()
    return References(rows) if len(rows) else None


def _divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """What each item adds to twice the Jensen-Shannon divergence."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of a histogram p to each row of q."""
    return np.sqrt(np.clip(_divergence(p, q).sum(axis=-1) / 2, 0, 1))


def surface(text: str) -> tuple[dict, dict]:
    """The surface counts of a text, and its words with their counts."""
    words = _word.findall(text)
    ids: dict = {}
    seq = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    counts = dict(zip(ids, np.bincount(seq, minlength=len(ids)).tolist())) if words else {}
    repeat = 0
    if len(seq) > 2:
        v = len(ids)
        _, pair = np.unique(seq[:-1] * v + seq[1:], return_inverse=True)
        _, inv, n = np.unique(pair[:-1] * v + seq[2:], return_inverse=True, return_counts=True)
        twice = np.flatnonzero(n[inv] > 1)
        hit = np.zeros(len(seq), dtype=bool)
        for k in range(3):
            hit[twice + k] = True
        repeat = int(hit.sum())
    seen: set = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _word.search(line):
            seen.add(line)
    points = codes(text)
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": int(np.isin(points, _SYMBOLS).sum()),
        "n_dup_lines": dup, "n_repeat_words": repeat, "points": points,
    }, counts


def judge(text: str, refs: References | None, lang: str | None = None) -> tuple:
    """The surface counts and their verdict, the distances to the nearest language, that language, and the distances to
    lang. Texts without a verdict by divergence have no nearest language."""
    s, counts = surface(text)
    failed = s["n_words"] < MIN_WORDS or 100 * s["n_repeat_words"] > MAX_REPEAT * s["n_words"]
    near, to_near, to_own = None, (None, None), (None, None)
    if refs is not None and s["n_words"]:
        c = class_counts(s["points"])
        d = np.stack((distance(c / c.sum(), refs.cls), refs.word_distances(counts, s["n_words"])))
        i = int(d.sum(axis=0).argmin())
        to_near = tuple(d[:, i].tolist())
        if lang is None or lang in refs.at:
            near = refs.langs[i]
        if lang in refs.at:
            to_own = tuple(d[:, refs.at[lang]].tolist())
    return s["n_words"], s["word_chars"], s["n_symbols"], s["n_dup_lines"], s["n_repeat_words"], failed, not failed, *to_near, near, *to_own


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"]
SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def limits(measured: DataFrame) -> DataFrame:
    """near, low, high (bands of lengths, low to below high), class_limit, word_limit."""
    own = measured.filter("kept and own_word is not null").groupBy(F.col("lang").alias("near"), F.col("band").alias("low"))
    quarters = lambda c: F.percentile_approx(c, [0.25, 0.5]).alias(c)
    found = own.agg(F.count("*").alias("c"), quarters("own_class"), quarters("own_word")).filter(F.col("c") >= MIN_DOCS)
    limit = lambda c, margin: F.col(c)[1] + F.greatest(F.lit(margin), SPREAD * (F.col(c)[1] - F.col(c)[0]))
    high = F.coalesce(F.lead("low").over(Window.partitionBy("near").orderBy("low")), F.lit(64))
    return found.select("near", "low", high.alias("high"), limit("own_class", CLASS_MARGIN).alias("class_limit"), limit("own_word", WORD_MARGIN).alias("word_limit"))


def rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id and the rules' columns for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(collect_references(references(docs, text_col, lang_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refs = shared.value
        for b in batches:
            rows = [judge(t or "", refs, x) for t, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2 + [pa.string()] + [pa.float64()] * 2
            cols = (pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))
            yield pa.record_batch([b.column(0), b.column(2), *cols], names=["id", "lang", *NAMES, "near", "own_class", "own_word"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    measured = slim.mapInArrow(lean(run), f"id {kind}, lang string, {SCHEMA}, near string, own_class double, own_word double")
    measured = stage(measured, "quality-measured").withColumn("band", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int"))
    lim = stage(limits(measured), "quality-limits").withColumnRenamed("near", "of")
    at = (F.col("near") == F.col("of")) & (F.col("band") >= F.col("low")) & (F.col("band") < F.col("high"))
    strange = F.coalesce((F.col("class_distance") > F.col("class_limit")) | (F.col("word_distance") > F.col("word_limit")), F.lit(False))
    return measured.join(small(lim), at, "left").withColumn("kept", F.col("kept") & ~strange).select("id", *NAMES)
