"""Book-level operators: overrides, page order, layout, names and batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, natural_key, quantile
from ..sources.work import kept


def resolve(images: DataFrame, overrides: DataFrame, keys: list[str], options: dict, flattened: str | None = None) -> DataFrame:
    """Images with their manual overrides (a left join), each option resolved: override, else option; skipped images go.

    A forced flattening switches it on against the options. Line dewarping without an override follows the option only where
    the page was not flattened: what the column flattened of images says, else what is asked for. unwarp_curl and content
    pass on where overrides have them. The option split is "auto" (or True), "always" or "none" (or False).
    """
    o = images.join(overrides, keys, "left").filter(~F.coalesce("skip", F.lit(False)))
    flat = F.coalesce("unwarp", F.lit(options["unwarp"]))
    split = F.when(F.col("split_mode") == "none", "none").when(F.col("split_mode") == "at", "at").otherwise({True: "auto", False: "none"}.get(options["split"], options["split"]))
    done = F.coalesce(F.col(flattened), F.lit(False)) if flattened else flat
    return o.select(
        *images.columns, F.coalesce("rotate", F.lit(options["rotate"])).alias("rotate"), flat.alias("unwarp"), split.alias("split"),
        F.when(split == "at", clamp(F.col("split_at"), 0.0, 1.0)).alias("split_at"), F.coalesce("dewarp", ~done & F.lit(options["dewarp"])).alias("dewarp"),
        *[c for c in ("unwarp_curl", "content") if c in overrides.columns],
    )


def page_order(pages: DataFrame, book: str, file: str, half: str | None = None, limit: int | None = None) -> DataFrame:
    """Pages with their index in the book, in natural order of files, then halves; the first limit only, if given."""
    order = Window.partitionBy(book).orderBy(natural_key(F.col(file)), file, *([half] if half else []))
    out = pages.withColumn("page_idx", F.row_number().over(order) - 1)
    return out if limit is None else out.filter(F.col("page_idx") < limit)


def layout(pages: DataFrame, book: str = "book_id", margin: float = 0.05) -> DataFrame:
    """One row a book: out_w, out_h, margin, median_w, median_h, from the content boxes (x, y, w, h; null: none) of its
    pages (page_idx, pw, ph). Without any box the first page gives the size."""
    m = F.round(F.least(F.max("w"), F.max("h")) * F.lit(margin)).cast("long")
    first = F.min_by(F.struct("pw", "ph"), "page_idx")
    return pages.groupBy(book).agg(
        F.coalesce(F.max("w") + 2 * m, first["pw"]).cast("long").alias("out_w"), F.coalesce(F.max("h") + 2 * m, first["ph"]).cast("long").alias("out_h"),
        m.alias("margin"), quantile(F.col("w"), 0.5).alias("median_w"), quantile(F.col("h"), 0.5).alias("median_h"),
    )


def _half(v: Column) -> Column:
    """Division by two towards zero."""
    return F.when(v < 0, F.ceil(v / 2)).otherwise(F.floor(v / 2)).cast("long")


def plan_crops(pages: DataFrame, book: str = "book_id", margin: float = 0.05) -> DataFrame:
    """Every page with the book's page size and its crop origin ox, oy. The layout is one row a book and is joined by book;
    a table of few books is broadcast by the optimiser, a large one shuffled."""
    p = pages.join(layout(pages, book, margin), book)
    w, h, x, y, ow, oh, m = (F.col(c) for c in ("w", "h", "x", "y", "out_w", "out_h", "margin"))
    wide, tall = w >= 0.8 * F.col("median_w"), h >= 0.8 * F.col("median_h")
    upper = y + h / 2 < 0.4 * F.col("ph")
    any_box = F.col("median_w").isNotNull()
    ox = F.when(~any_box, F.lit(0)).when(w.isNull(), _half(F.col("pw") - ow)).when(wide, x - m).otherwise(x + F.floor(w / 2) - F.floor(ow / 2))
    oy = F.when(~any_box, F.lit(0)).when(w.isNull(), _half(F.col("ph") - oh)).when(tall | upper, y - m).otherwise(y + F.floor(h / 2) - F.floor(oh / 2))
    return p.select(book, "page_idx", "out_w", "out_h", ox.cast("long").alias("ox"), oy.cast("long").alias("oy"))


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Distinct keys, each by its first row."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__n = 1").drop("__n")


def placed(rows: DataFrame, key: str, order: list) -> DataFrame:
    """rows with __i, from 1: their place within the key. Ranges of (key, order) are sorted apart and shifted by the counts of
    the ranges before, so a key that most rows share is not sorted in one task."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = kept(rows, "names").repartitionByRange(parts, key, *order).sortWithinPartitions(key, *order)
    ranged = kept(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "ranges")
    runs = ranged.groupBy(key, "__part").agg(F.min("__seq").alias("__first"), F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(key).orderBy("__part")) - F.col("__rows")
    runs = kept(runs.select(key, "__part", (before - F.col("__first") + 1).alias("__shift")), "runs")
    return ranged.join(runs, [key, "__part"]).withColumn("__i", F.col("__seq") + F.col("__shift")).drop("__part", "__seq", "__shift")


#: A name that a numbered one may clash with: what stands before its number, and the number.
NUMBERED = r"(?s)^(.*) \(([2-9]|[1-9][0-9]+)\)$"


def output_names(books: DataFrame, name: str, order: list) -> DataFrame:
    """books with output: name.pdf for the first book of a name (without case), then name (2).pdf and so on, the first one
    that no book before it has taken.

    The books of one name take growing numbers, by their places, but for the numbers that a book before them bears in its own
    name; where a name has such namesakes, numbers move up past those that are met, name by name from its first book that meets
    one, until none is met. A book whose own name
    was taken by a numbered one before it is numbered itself; so names are settled by how many numbers they end in, plain
    ones first.
    """
    rows = books.withColumn("__key", F.lower(F.coalesce(name, F.lit(""))))
    turns = placed(rows.withColumn("__all", F.lit(0)), "__all", order).withColumnRenamed("__i", "__turn").drop("__all")
    rows = kept(placed(turns, "__key", ["__turn"]), "turns")
    parts = F.regexp_extract("__key", NUMBERED, 2)
    first = rows.filter("__i = 1").select(F.regexp_extract("__key", NUMBERED, 1).alias("stem"), parts.try_cast("long").alias("number"), F.col("__key").alias("bearer"), F.col("__turn").alias("since"))
    first = kept(first.filter("number is not null"), "bearers")
    # only where the stem is a name too do numbers meet
    deep = F.length(F.regexp_replace(F.regexp_extract("__key", r"(?s)(( \([0-9]+\))*)$", 1), r"[^(]", ""))
    names = kept(rows.select("__key", deep.alias("depth")).distinct(), "depths")
    bearing = kept(first.join(names.select(F.col("__key").alias("stem")), "stem"), "bearing")
    plain = rows.withColumn("__k", F.col("__i"))
    if not bearing.take(1):
        return _named(plain, name)
    odd = kept(bearing.select(F.col("stem").alias("__key")).union(bearing.select("bearer")).distinct(), "odd")
    done, settled = [plain.join(odd, "__key", "left_anti")], None
    for depth in range(int(names.agg(F.max("depth")).first()[0]) + 1):
        mine = rows.join(odd.join(names.filter(F.col("depth") == depth), "__key").select("__key"), "__key")
        if settled is not None:  # the bare name is lost where the stem's books took the number before
            lost = bearing.join(settled.select(F.col("__key").alias("stem"), F.col("__k").alias("number"), F.col("__turn").alias("at")), ["stem", "number"]).filter("at < since").select(F.col("bearer").alias("__key"), F.lit(1).alias("lost"))
            mine = mine.join(lost, "__key", "left")
        else:
            mine = mine.withColumn("lost", F.lit(None).cast("int"))
        state = kept(mine.withColumn("__k", F.col("__i") + F.coalesce("lost", F.lit(0))).drop("lost"), "claims")
        while True:
            met = state.filter("__k > 1").join(bearing.select(F.col("stem").alias("__key"), F.col("number").alias("__k"), "since"), ["__key", "__k"]).filter(F.col("since") < F.col("__turn"))
            # of each name the first book that meets one: it and those behind move past all that stand in a row before it
            met = kept(met.groupBy("__key").agg(F.min(F.struct("__i", "__k", "__turn")).alias("at")), "met")
            if not met.take(1):
                break
            ahead = met.join(bearing.select(F.col("stem").alias("__key"), "number", "since"), "__key").filter((F.col("since") < F.col("at.__turn")) & (F.col("number") >= F.col("at.__k")))
            ahead = ahead.groupBy("__key", "at").agg(F.sort_array(F.collect_set("number")).alias("row"))
            gap = F.size(F.filter("row", lambda v, i: v == F.col("at.__k") + i))
            state = state.join(ahead.select("__key", F.col("at.__i").alias("from"), gap.alias("gap")), "__key", "left")
            state = state.withColumn("__k", F.col("__k") + F.when(F.col("__i") >= F.col("from"), F.col("gap")).otherwise(0)).drop("from", "gap")
            state = kept(state, "claims")
        settled = state if settled is None else settled.unionByName(state)
        done.append(state)
    return _named(reduce(DataFrame.unionByName, [d.select(plain.columns) for d in done]), name)


def _named(rows: DataFrame, name: str) -> DataFrame:
    full = F.concat(name, F.when(F.col("__k") > 1, F.format_string(" (%d)", "__k")).otherwise(""), F.lit(".pdf"))
    return rows.withColumn("output", full).drop("__key", "__turn", "__i", "__k")


def next_numbers(files: DataFrame, book: str, file: str) -> DataFrame:
    """book, and the number that its next uploaded file gets: one above the largest numeric stem of 32 bits."""
    stem = F.regexp_extract(file, r"^([0-9]+)\.[^.]+$", 1).try_cast("long")
    return files.groupBy(book).agg((F.coalesce(F.max(F.when(stem < 1 << 32, stem)), F.lit(0)) + 1).alias("next"))


def asof_line(probes: DataFrame, knots: DataFrame, key: str | list[str], at: str, value: str) -> DataFrame:
    """Probes (key, at, ...; key may be several columns) with the value of the knots (key, at, value; one a place) at their place: linear between the
    nearest knots, constant beyond the ends. One sort by key and place, no join."""
    key = [key] if isinstance(key, str) else key
    cols = [c for c in probes.columns if c not in (*key, at)]
    both = probes.select(*key, at, F.lit(1).alias("__probe"), F.lit(None).cast("double").alias("__v"), *cols).unionByName(
        knots.select(*key, at, F.lit(0).alias("__probe"), F.col(value).cast("double").alias("__v")), allowMissingColumns=True
    )
    knot = F.when(F.col("__probe") == 0, F.struct(F.col(at).alias("t"), F.col("__v").alias("v")))
    order = Window.partitionBy(*key).orderBy(at, "__probe")
    both = both.withColumn("__a", F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    back = Window.partitionBy(*key).orderBy(F.desc(at), F.desc("__probe"))  # from behind, so that each row adds one
    both = both.withColumn("__b", F.last(knot, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.col("__b.t") - F.col("__a.t")
    share = F.when(gap < 1e-6, 0.5).otherwise((F.col(at) - F.col("__a.t")) / gap)
    line = F.col("__a.v") + (F.col("__b.v") - F.col("__a.v")) * share
    return both.filter("__probe = 1").select(*key, at, *cols, F.coalesce(line, "__a.v", "__b.v").alias(value))


def arc_length(rows: DataFrame, key: str, order: str, height: str, step: float) -> DataFrame:
    """Rows with s, the length of the curve through their heights up to them, at places step apart."""
    w = Window.partitionBy(key).orderBy(order)
    dz = F.col(height) - F.lag(height).over(w)
    return rows.withColumn("__d", F.coalesce(F.sqrt(F.lit(step * step) + dz * dz), F.lit(0.0))).withColumn("s", F.sum("__d").over(w)).drop("__d")
