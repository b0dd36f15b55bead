"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds (assign, access, hex) stand alone. Weak kinds (login names, long mixed strings, endpoints) are reported only
where complementary parts co-occur: the spans of a document meet in an interval join whose scope is REACH characters around
a span. Parts are different strings: a long mixed string within a login or an endpoint belongs to it, and is no secret. One window up and one down the spans of a document give, for each, the nearest span of each role before and after
it, so the work grows with a text's length and its number of spans, however long the text.

Nulls: a null text is empty; a null id stays null. Repeated rows are reported each. Positions are code points, ends
exclusive. An empty table gives an empty result; columns of any name may be kept. Java, RE2 and Python agree on the patterns, which name both letter cases
instead of a flag.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REACH = 200


def either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


ASSIGN_VALUE = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN = f"({either_case('password|passwd|secret|token|api_?key')}){ASSIGN_VALUE}"
LOGIN = f"""({either_case('user_?name|user|login|account|client_?id|access_?key_?id')})["']?\\x20*[:=]\\x20*["']?[A-Za-z0-9._@+-]{{3,}}"""
#: kind, its number, its role, its pattern, what each match must satisfy. The first three are the base kinds; their least
#: lengths stand in the pattern where that finds the same runs.
KINDS = (
    ("assign", 1, "secret", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    ("access", 2, "name", r"AKIA[A-Z0-9]{16,}", None),
    ("hex", 3, "secret", r"[0-9a-f]{24,}", None),
    ("login", 4, "name", LOGIN, None),
    ("opaque", 5, "secret", r"[A-Za-z0-9+/_-]{20,}={0,2}", lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")),
    ("endpoint", 6, "endpoint", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+", None),
)
BASE = 3
#: The kind whose strings may be part of the spans of other kinds.
OPAQUE, OWNERS = 5, [4, 6]
#: The roles that complete each role.
COMPLETES = {"secret": ("name", "endpoint"), "name": ("secret",), "endpoint": ("secret",)}


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut before and after each match: matches stand in the odd places. NUL marks the cuts; one that the text
    has itself, which no pattern matches, gives way to another character of the same length."""
    return F.split(F.regexp_replace(F.translate(text, "\0", "\1"), F.lit(pattern), F.lit("\0$0\0")), "\0")


def _rows(pieces: Column, number: int, holds) -> Column:
    """The pieces of one kind: number, order, length and whether the piece is a match that counts."""
    ok = lambda m, i: (i % 2 == 1) & (holds(m) if holds else F.lit(True))
    rows = F.transform(pieces, lambda m, i: F.struct(F.lit(number).alias("number"), i.alias("i"), F.length(m).alias("len"), ok(m, i).alias("holds")))
    return F.when(F.size(pieces) > 1, rows).otherwise(F.from_json(F.lit("[]"), "array<struct<number:int,i:int,len:int,holds:boolean>>"))


def spans(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), reach: int = REACH) -> DataFrame:
    """One row a document: the kept columns under "kept", and "spans", an array of (start, number, kind, end) in order:
    base spans and the weak ones that are linked. Rows are told apart by a number of their own, not by their ids."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("kept"), *[_pieces(text, p).alias(k) for k, _, _, p, _ in KINDS])
    found = slim.select("row", "kept", F.posexplode_outer(F.concat(*[_rows(F.col(k), n, h) for k, n, _, _, h in KINDS])).alias("pos", "m"))
    # the kept columns travel with one piece only
    found = found.select("row", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("kept")).alias("kept"), "m.*")
    each = Window.partitionBy("row", "number").orderBy("i")
    found = found.repartition("row").withColumn("end", F.sum("len").over(each).cast("long")).filter(F.coalesce(F.col("i") % 2 == 1, F.lit(True)) | F.col("kept").isNotNull())
    found = found.withColumn("start", F.col("end") - F.col("len")).withColumn("holds", F.coalesce("holds", F.lit(False)))
    up, down = Window.partitionBy("row").orderBy("start", "number"), Window.partitionBy("row").orderBy(F.desc("start"), F.desc("number"))
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (up, down))
    of = lambda numbers: F.col("holds") & F.col("number").isin(numbers)
    base = list(range(1, BASE + 1))
    # a string that is part of another weak span is that one's value or path, and no part of its own
    found = found.select("*", F.max(F.when(of(OWNERS), F.col("end"))).over(before).alias("owner_before"))
    found = found.select("*", F.min(F.when(of(OWNERS), F.col("start"))).over(after).alias("owner_after"))
    owned = F.coalesce(F.col("owner_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("owner_after") < F.col("end"), F.lit(False))
    found = found.withColumn("holds", F.col("holds") & ~((F.col("number") == OPAQUE) & owned))
    roles = {r: [n for _, n, role, _, _ in KINDS if role == r] for r in COMPLETES}
    found = found.select("*", F.max(F.when(of(base), F.col("end"))).over(before).alias("base_before"), *[F.max(F.when(of(n), F.col("end"))).over(before).alias(f"{r}_before") for r, n in roles.items()])
    found = found.select("*", F.min(F.when(of(base), F.col("start"))).over(after).alias("base_after"), *[F.min(F.when(of(n), F.col("start"))).over(after).alias(f"{r}_after") for r, n in roles.items()])
    overlaps = F.coalesce(F.col("base_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("base_after") < F.col("end"), F.lit(False))
    near = lambda r: F.coalesce(F.col("start") - F.col(f"{r}_before") <= reach, F.lit(False)) | F.coalesce(F.col(f"{r}_after") - F.col("end") <= reach, F.lit(False))
    linked = reduce(lambda a, b: a | b, [F.col("number").isin(roles[r]) & reduce(lambda a, b: a | b, map(near, need)) for r, need in COMPLETES.items()])
    name = F.element_at(F.array(*[F.lit(k[0]) for k in KINDS]), F.coalesce("number", F.lit(1)))
    good = F.when(F.col("holds") & ((F.col("number") <= BASE) | (linked & ~overlaps)), F.struct("start", "number", name.alias("kind"), "end"))
    return found.groupBy("row").agg(F.first("kept", ignorenulls=True).alias("kept"), F.sort_array(F.collect_list(good)).alias("spans")).drop("row")


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every reported span replaced by mark; overlapping spans become one mark. Texts without spans stay as
    they are, null included."""
    out = spans(docs, text_col, keep=[F.col(c) for c in docs.columns])
    text = F.col(f"kept.`{text_col}`")
    # where each mark goes: the stretches that spans cover together, then the text between them
    step = lambda acc, s: F.struct(
        F.when(s["start"] >= acc["at"], F.concat(acc["keep"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"))))).otherwise(acc["keep"]).alias("keep"),
        F.greatest(acc["at"], s["end"]).alias("at"),
    )
    none = F.from_json(F.lit("[]"), "array<struct<from:bigint,to:bigint>>")
    cut = F.aggregate("spans", F.struct(none.alias("keep"), F.lit(0).cast("long").alias("at")), step)
    out = out.select("kept", "spans", cut.alias("cut"))
    part = lambda a, z: text.substr((a + 1).cast("int"), (z - a).cast("int"))
    kept = F.concat(F.transform("cut.keep", lambda k: part(k["from"], k["to"])), F.array(part(F.col("cut.at"), F.length(text))))
    clean = F.when(F.size("spans") > 0, F.array_join(kept, mark)).otherwise(text)
    return out.select(*[(clean if c == text_col else F.col(f"kept.`{c}`")).alias(c) for c in docs.columns])
