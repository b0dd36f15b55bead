"""Mixing sources to target weights by hash-threshold histograms.

A source's budget is met by whole copies of all its documents and, for the rest, by every document whose hash is at most
the source's threshold. The threshold comes from histograms: words by source and leading hash bits give the bucket in which
the budget ends; only that boundary bucket is refined by the next bits, until it holds one hash value. No rows are sorted.

Nulls: a null text has no words; a null source is a source of its own, the last; a null id hashes as the empty text.
Documents hash by id and text, so that texts which share an id, or lack one, are taken one by one; rows equal in both share
a hash and are taken together. Very long texts count whole, and no document is cut, so a source meets its target to within
its longest document. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, small, stage

WEIGHTS = (1, 2, 3)
CAP = 3
#: Hash bits that one histogram resolves, and the number of histograms.
BITS, LEVELS = 12, 3


def _hash(id_col: str, text_col: str):
    own = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, BITS * LEVELS // 4), 16, 10).cast("long")


def _key(source_col: str):
    return F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col).cast("string")))


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, key, size and hash of each document, staged: all that mixing reads again."""
    return stage(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _key(source_col).alias("key"), n_words(F.col(text_col)).alias("size"), _hash(id_col, text_col).alias("h")),
        "mix-sized",
    )


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """key, source_size and target of each source. sizes: one row a source, so the windows without a key are as small.

    Sources by code point weigh weights in turn and share all words; where a share exceeds cap times the source's size,
    it stops there and the excess goes to the others by weight. With sources ordered by cap / weight, those before the
    first one whose share stays below its cap are the capped ones.
    """
    by_name = Window.orderBy(F.col("key") == "n", "key")
    by_ratio = Window.orderBy("ratio", "key")
    s = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1)).cast("double"))
    s = s.withColumn("most", (F.col("source_size") * cap).cast("double")).withColumn("ratio", F.col("most") / F.col("w"))
    s = s.withColumn("total", F.sum("source_size").over(Window.partitionBy()).cast("double"))
    s = s.withColumn("before", F.sum("most").over(by_ratio) - F.col("most")).withColumn("rest", F.sum("w").over(Window.partitionBy()) - F.sum("w").over(by_ratio) + F.col("w"))
    s = s.withColumn("level", (F.col("total") - F.col("before")) / F.col("rest"))
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(Window.partitionBy())["level"])
    return s.select("key", "source_size", F.coalesce(F.least("most", F.col("w") * F.col("level")), "most").alias("target"))


def thresholds(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """From sized(): key, source_size, target, full (copies of every document) and upto (the hash up to which documents
    are taken once more; -1 for none)."""
    bucket = lambda level: F.shiftright("h", BITS * (LEVELS - level))
    hist = docs.groupBy("key", bucket(1).alias("b")).agg(F.sum("size").alias("words"))
    hist = stage(hist, "mix-hist")
    bounds = targets(hist.groupBy("key").agg(F.sum("words").alias("source_size")), weights, cap)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    bounds = bounds.withColumn("full", full).withColumn("left", F.when(F.col("full") < cap, F.col("target") - F.col("full") * F.col("source_size")).otherwise(0.0))
    for level in range(1, LEVELS + 1):
        within = Window.partitionBy("key").orderBy("b")
        cum = hist.join(bounds, "key").withColumn("cum", F.sum("words").over(within))
        ends = cum.filter(F.col("cum") > F.col("left")).groupBy("key").agg(F.min(F.struct("b", "words", "cum")).alias("at"))
        rest = F.col("left") - (F.col("at.cum") - F.col("at.words"))
        bounds = bounds.join(ends, "key", "left").withColumn("left", F.coalesce(rest, "left"))
        bounds = stage(bounds.withColumn("bucket", F.col("at.b")).withColumn("words", F.col("at.words")).select("key", "source_size", "target", "full", "left", "bucket", "words"), f"mix-bounds{level}")
        if level < LEVELS:
            inside = docs.join(small(bounds.filter("bucket is not null").select("key", "bucket")), "key").filter(bucket(level) == F.col("bucket"))
            hist = stage(inside.groupBy("key", bucket(level + 1).alias("b")).agg(F.sum("size").alias("words")), "mix-hist")
            bounds = bounds.drop("bucket", "words")
    # the last bucket is one hash value: it is taken if that comes nearer to the budget
    upto = F.col("bucket") - F.when(F.col("words") - F.col("left") < F.col("left"), 0).otherwise(1)
    return stage(bounds.select("key", "source_size", "target", "full", F.coalesce(upto, F.lit(-1)).alias("upto")), "mix-thresholds")


def copies():
    """How often a document of sized() joined with thresholds() is taken."""
    return F.col("full") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """id, source, size, source_size, target and taken (words that the mix takes of the document)."""
    slim = sized(docs)
    out = slim.join(small(thresholds(slim, weights, cap)), "key")
    return out.select("id", "source", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    bounds = small(thresholds(sized(docs, id_col, text_col, source_col), weights, cap).select(F.struct("key", "full", "upto").alias("__mix")))
    out = docs.join(bounds, _key(source_col) == F.col("__mix.key"))
    times = F.col("__mix.full") + F.when(_hash(id_col, text_col) <= F.col("__mix.upto"), 1).otherwise(0)
    # a document without words is never worth a copy, nor a reason to leave it out of a source that is taken whole
    return out.withColumn("__mix", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(docs.columns)
