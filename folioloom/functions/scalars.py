"""Scalar expressions: natural order, names, rounding, quantiles, encoded names. Columns in, columns out; no UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file types a book may hold.
EXTENSIONS = ("jpg", "jpeg", "png", "tif", "tiff", "webp", "bmp", "gif", "heic", "heif")
_LOWER, _UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def natural_key(s: Column) -> Column:
    """Sort by (natural_key(s), s): digit runs by value, other characters without ASCII case."""
    runs = F.regexp_extract_all(F.translate(s, _LOWER, _UPPER), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def one(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+", "")
        return F.when(x.rlike("^[0-9]"), F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 5, "0"), digits)).otherwise(x)

    return F.array_join(F.transform(runs, one), "")


def tree_key(path: Column) -> Column:
    """Sort key of directories: component by component, so that a directory precedes what it holds."""
    return F.transform(F.split(path, "/"), lambda c: F.struct(natural_key(c).alias("key"), c.alias("name")))


def extension(name: Column) -> Column:
    return F.translate(F.regexp_extract(name, r"\.([^.]+)$", 1), _UPPER, _LOWER)


def is_image(name: Column) -> Column:
    """Visible (no leading _ or .) and of a supported type."""
    return ~name.rlike("^[_.]") & extension(name).isin(*EXTENSIONS)


def percent_encoded(s: Column) -> Column:
    """Letters, digits, - _ . stay; every other byte becomes %XX."""
    return F.replace(F.replace(F.replace(F.url_encode(s), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("~"), F.lit("%7E"))


def parent(path: Column) -> Column:
    return F.regexp_replace(path, r"[/\\][^/\\]*$", "")


def valid_book_name(name: Column) -> Column:
    n = F.trim(name)
    return (n != "") & ~n.rlike(r"^[._]") & ~n.rlike(r"[/\\:\x00-\x1f\x7f]")


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def quantile(v: Column, q: float) -> Column:
    """Nearest rank, as an aggregate: the sorted value at round((n - 1) * q); null for no value."""
    return F.try_element_at(F.sort_array(F.collect_list(v)), F.greatest(F.round((F.count(v) - 1) * F.lit(q)) + 1, F.lit(1)).cast("int"))


def at_share(v: Column, q: float) -> Column:
    """The sorted value at trunc(n * q), as an aggregate."""
    return F.try_element_at(F.sort_array(F.collect_list(v)), (F.floor(F.count(v) * F.lit(q)) + 1).cast("int"))


def polynomial(coefficients: Column, u: Column) -> Column:
    """Value at u of ascending coefficients."""
    return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda r, x: r * u + x)


def progress(kind: Column, done: Column, total: Column, sharpen: bool) -> Column:
    """Share of a conversion that is done after an event; null when finished."""
    p = F.coalesce(done / total, F.lit(0.0))
    first = 0.4 if sharpen else 0.8
    return F.when(kind == "processed", p * first).when(kind == "sharpened", 0.4 + 0.45 * p).when(kind == "encoded", (0.85 if sharpen else 0.8) + 0.15 * p)


def page_points(px: Column, dpi: Column) -> Column:
    return F.format_string("%.3f", px * 72.0 / dpi)
