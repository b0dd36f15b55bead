"""Page kernels in relational form. A page is its pixels: page_id, x, y, g (0 dark to 255). Windows and groups are keyed by
page, so pages spread over the cluster and no kernel sees more than one page at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import runs


def along_row():
    return Window.partitionBy("page_id", "y").orderBy("x")


def along_column():
    return Window.partitionBy("page_id", "x").orderBy("y")


def page():
    return Window.partitionBy("page_id")


def grey_pages(vectors: DataFrame, width: int = 8) -> DataFrame:
    """Vectors as grey pages: position by row, values -0.5 to 0.5 as 0 to 255."""
    g = F.least(F.greatest(F.round((F.col("v").cast("double") + 0.5) * 255), F.lit(0.0)), F.lit(255.0)).cast("int")
    px = vectors.select(F.col("vec_id").alias("page_id"), F.posexplode("embedding").alias("p", "v"))
    return px.select("page_id", (F.col("p") % width).cast("int").alias("x"), F.floor(F.col("p") / width).cast("int").alias("y"), g.alias("g"))


def luma(r: Column, g: Column, b: Column) -> Column:
    """Integer luma of an RGB pixel (Rec. 709 weights in ten thousandths)."""
    return F.floor((r * 2126 + g * 7152 + b * 722) / 10000).cast("int")


def flatten_to_white(c: Column, alpha: Column) -> Column:
    return F.floor((c * alpha + 255 * (255 - alpha)) / 255).cast("int")


def column_profile(px: DataFrame, ink_below: int, trim: float = 0.1) -> DataFrame:
    """Share of ink and mean luminance of each column, over the rows between the trimmed top and bottom."""
    h = F.max("y").over(page()) + 1
    inner = px.withColumn("h", h).filter((F.col("y") >= F.floor(F.col("h") * trim)) & (F.col("y") < F.col("h") - F.floor(F.col("h") * trim)))
    return inner.groupBy("page_id", "x").agg(F.avg((F.col("g") <= ink_below).cast("int")).alias("ink"), F.avg("g").alias("lum"))


def box_smooth(profile: DataFrame, value: str, radius: int, out: str) -> DataFrame:
    """Mean over the columns within radius, fewer at the ends."""
    return profile.withColumn(out, F.avg(value).over(Window.partitionBy("page_id").orderBy("x").rowsBetween(-radius, radius)))


def smoothed(v: Column, radius: Column) -> Column:
    """The mean of an array's values within radius of each, fewer at the ends."""

    def one(_, x):
        low, high = F.greatest(x - radius, F.lit(0)), F.least(x + radius, F.size(v) - 1)
        return F.aggregate(F.slice(v, low + 1, high - low + 1), F.lit(0.0), lambda a, e: a + e) / (high - low + 1)

    return F.transform(v, one)


def gutter(px: DataFrame, ink_below: int, half_width: float = 0.15) -> DataFrame:
    """page_id, x and score of the column near the middle (within half_width of the width) that is emptiest, darkest against
    its surroundings and nearest the middle; the first one wins a tie. Profiles are smoothed over a hundredth of the width on
    either side (two columns at least), the surroundings over a fifteenth. A page's profile is one row."""
    p = column_profile(px, ink_below).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("x", F.col("ink").cast("double").alias("ink"), F.col("lum").cast("double").alias("lum")))).alias("p"))
    w = F.size("p")
    near = F.greatest(F.floor(w / 100), F.lit(2)).cast("int")
    p = p.select("page_id", "p", smoothed(F.col("p.ink"), near).alias("ink"), smoothed(F.col("p.lum"), near).alias("lum"), smoothed(F.col("p.lum"), F.floor(w / 15).cast("int")).alias("wide"))
    low, high = (F.floor(w * (0.5 + side * half_width)).cast("int") for side in (-1, 1))
    most = F.greatest(F.array_max(F.slice("ink", low + 1, F.greatest(high - low, F.lit(0)))), F.lit(1e-9))
    p = p.withColumn("most", most).withColumn("x", F.explode(F.filter(F.sequence(F.lit(0), w - 1), lambda x: (x >= low) & (x < high))))
    at = lambda c: F.element_at(c, F.col("x") + 1)
    dark = F.least(F.greatest((at("wide") - at("lum")) / 40, F.lit(0.0)), F.lit(1.0))
    score = F.round((1 - at("ink") / F.col("most") + dark) * (1 - F.abs(F.col("x") / w - 0.5) / half_width * 0.3), 9)
    best = p.select("page_id", "x", score.alias("score")).groupBy("page_id").agg(F.max(F.struct("score", (-F.col("x")).alias("x"))).alias("b"))
    return best.select("page_id", (-F.col("b.x")).alias("x"), F.col("b.score").alias("score"))


def max_filter(px: DataFrame, radius: int) -> DataFrame:
    rows = px.withColumn("m", F.max("g").over(along_row().rowsBetween(-radius, radius)))
    return rows.withColumn("m", F.max("m").over(along_column().rowsBetween(-radius, radius)))


def adaptive_ink(px: DataFrame, block: int, c: int) -> DataFrame:
    """ink where a pixel is darker, by c or more, than the mean of the block around it (cut off at the edges)."""
    r = block // 2
    sums = px.withColumn("s", F.sum("g").over(along_row().rowsBetween(-r, r))).withColumn("n", F.count("*").over(along_row().rowsBetween(-r, r)))
    sums = sums.withColumn("s", F.sum("s").over(along_column().rowsBetween(-r, r))).withColumn("n", F.sum("n").over(along_column().rowsBetween(-r, r)))
    return sums.withColumn("ink", (F.col("g") + c) * F.col("n") <= F.col("s")).drop("s", "n")


def close_horizontal(mask: DataFrame, width: int) -> DataFrame:
    """Dilation over [x - a, x - a + width - 1], then the mirrored erosion; what lies outside is ignored. mask: on (0, 1)."""
    a = width // 2
    d = mask.withColumn("d", F.max("on").over(along_row().rowsBetween(-a, width - 1 - a)))
    return d.withColumn("closed", F.min("d").over(along_row().rowsBetween(-(width - 1 - a), a))).drop("d")


def otsu(px: DataFrame) -> DataFrame:
    """page_id and level: the grey level whose split has the largest variance between classes, the first one of a tie."""
    h = px.groupBy("page_id", "g").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("page_id").orderBy("g")
    h = h.withColumn("w0", F.sum("n").over(upto)).withColumn("s0", F.sum(F.col("n") * F.col("g")).over(upto))
    h = h.withColumn("w", F.sum("n").over(page())).withColumn("s", F.sum(F.col("n") * F.col("g")).over(page())).withColumn("w1", F.col("w") - F.col("w0"))
    # w0 * w1 * (mean0 - mean1)**2, without fractions but for the last division
    gap = F.col("s0") * F.col("w1") - (F.col("s") - F.col("s0")) * F.col("w0")
    h = h.withColumn("v", F.when(F.col("w1") > 0, F.round(gap.cast("double") * gap / (F.col("w0") * F.col("w1")), 6)).otherwise(0.0))
    best = h.groupBy("page_id").agg(F.max(F.struct("v", (-F.col("g")).alias("g"))).alias("b"))
    return best.select("page_id", (-F.col("b.g")).cast("int").alias("level"))


def projection_scores(px: DataFrame, ink_below: int, slopes: list[int]) -> DataFrame:
    """page_id, slope and the sum of squared counts of ink pixels that share a line y - x * slope / 8. Few slopes are given."""
    ink = px.filter(F.col("g") <= ink_below).withColumn("slope", F.explode(F.array(*map(F.lit, slopes))))
    bins = ink.groupBy("page_id", "slope", F.floor((F.col("y") * 8 - F.col("x") * F.col("slope")) / 8).alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("page_id", "slope").agg(F.sum(F.col("n") * F.col("n")).alias("score"))


def is_grey(px: DataFrame, r: str, g: str, b: str, stride: int = 7, tolerance: int = 40, share: float = 0.002) -> DataFrame:
    """page_id and grey: whether fewer than share of every stride-th pixel, by rows, are coloured."""
    pos = F.row_number().over(Window.partitionBy("page_id").orderBy("y", "x")) - 1
    coloured = F.greatest(r, g, b) - F.least(r, g, b) > tolerance
    s = px.withColumn("pos", pos).filter(F.col("pos") % stride == 0)
    return s.groupBy("page_id").agg((F.avg(coloured.cast("int")) < share).alias("grey"))


def rotate(px: DataFrame, degrees: int) -> DataFrame:
    """Clockwise by 90, 180 or 270; other angles leave the page as it is."""
    p = px.withColumn("w", F.max("x").over(page())).withColumn("h", F.max("y").over(page()))
    x, y, w, h = (F.col(c) for c in "xywh")
    to = {90: (h - y, x), 180: (w - x, h - y), 270: (y, w - x)}.get(degrees % 360, (x, y))
    return p.select(*[c for c in px.columns if c not in "xy"], to[0].alias("x"), to[1].alias("y"))


def split_at(px: DataFrame, at: Column) -> DataFrame:
    """Pages with half: 0 left of at, 1 from at on, its x starting anew; null where at lies outside the page."""
    w = F.max("x").over(page()) + 1
    p = px.withColumn("at", F.when((at > 0) & (at < w), at))
    half = F.when(F.col("at").isNull(), F.lit(None)).otherwise((F.col("x") >= F.col("at")).cast("int"))
    return p.withColumn("half", half).withColumn("x", F.col("x") - F.when(F.col("half") == 1, F.col("at")).otherwise(0)).drop("at")


def crop(px: DataFrame, ox: int, oy: int, width: int, height: int) -> DataFrame:
    """The page cut at an origin that may lie outside it; white where there is no page."""
    target = px.select("page_id").distinct().select("page_id", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    target = target.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
    source = px.select("page_id", (F.col("x") - ox).alias("x"), (F.col("y") - oy).alias("y"), "g")
    return target.join(source, ["page_id", "x", "y"], "left").withColumn("g", F.coalesce("g", F.lit(255)))


def fill_outside(px: DataFrame, x0: int, y0: int, x1: int, y1: int, pad: int) -> DataFrame:
    inside = F.col("x").between(x0 - pad, x1 + pad - 1) & F.col("y").between(y0 - pad, y1 + pad - 1)
    return px.withColumn("g", F.when(inside, F.col("g")).otherwise(255))


def divide_background(g: Column, background: Column, white: int = 235) -> Column:
    b = F.greatest(background, F.lit(16))
    return F.least(F.greatest(F.round(g * 255.0 / b * 255.0 / white), F.lit(0.0)), F.lit(255.0)).cast("int")


def components(mask: DataFrame) -> DataFrame:
    """8-connected components of pages' ink pixels (page_id, x, y), labelled by their least y * 2**16 + x: page_id, label,
    left, top, width, height, area. They are found on runs."""
    return runs.components(runs.runs(mask))


def content_box(parts: DataFrame) -> DataFrame:
    """page_id and the union of components' boxes: x, y, w, h."""
    right, low = F.max(F.col("left") + F.col("width")), F.max(F.col("top") + F.col("height"))
    return parts.groupBy("page_id").agg(F.min("left").alias("x"), F.min("top").alias("y"), (right - F.min("left")).alias("w"), (low - F.min("top")).alias("h"))
