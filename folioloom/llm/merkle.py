"""Merkle manifest of a dataset, with octopus multiproofs.

Rows are leaves, and the leaves of one group (a language, say) stand in order below its subroot; subroots, in order of their
groups, stand below the root. A node is the SHA-256 of its children's lowercase hex digests, two by two; the last run of a
level may be a lone node, which is hashed too. A lone leaf is its own root.

Leaves get their places without a global sort in one task: ranges of (group, order) are sorted apart, and the counts of the
ranges shift the places within them. Trees are built in parts of 2**LEVELS places: a task gives the top of each part, and
the tops, fewer by that factor, are the leaves of the next round. For proofs, every leaf partition computes the minimal union
of coordinates that all its proofs need and its leaves can't give (the octopus), fetches those nodes in one join, derives the
interiors that proofs share, and expands each proof in place. So a large group is spread over many tasks, and a task holds one
part. The subroots go the same way, as leaves of one more tree.

Nulls: a null field is a mark of its own in the leaf; a null group is the first group, a null order value comes first. Rows
equal in their order stand in the order of their leaves; equal leaves of equal order are numbered as they were read. Very long
texts are hashed where they are read. An empty table has no leaf, no root, and gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stage

LEVELS = 13
NODE = "grp string, level int, idx long, total long, hash string, above int"


def field(c: Column) -> Column:
    """A value in a leaf: "-" for null, else its length in bytes, a colon, and the value as text."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def group_key(c: Column) -> Column:
    """Groups as text that orders null first, then by bytes."""
    return F.when(c.isNull(), "0").otherwise(F.concat(F.lit("1"), c.cast("string")))


def depth(total: int) -> int:
    """Levels above the leaves of a tree."""
    return (total - 1).bit_length() if total else 0


def joined(*digests: bytes) -> bytes:
    return sha256(b"".join(digests)).hexdigest().encode()


def parents(nodes: list[bytes]) -> list[bytes]:
    return [joined(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]


def missing(known: np.ndarray, total: int) -> list[tuple[int, int]]:
    """The octopus: (level, place) of every node that the proofs of these leaves need and that the leaves don't give, once
    each. known: ascending places."""
    out, level = [], 0
    while total > 1:
        other = known ^ 1
        at = np.minimum(np.searchsorted(known, other), len(known) - 1)
        out += [(level, int(i)) for i in other[(known[at] != other) & (other < total)]]
        half = known >> 1
        known = half[np.concatenate(([True], half[1:] != half[:-1]))]
        total, level = (total + 1) >> 1, level + 1
    return out


class Known:
    """The nodes that a leaf partition has: its leaves, what it fetched, and every interior that these give."""

    def __init__(self, total: int, places: list[int], leaves: list[bytes], fetched: dict[tuple[int, int], bytes]):
        self.total, self.depth = total, depth(total)
        self.levels: list[dict[int, bytes]] = [dict(zip(places, leaves))]
        width = total
        for level in range(self.depth):
            here = self.levels[level]
            path = {i >> 1 for i in here}
            here.update({i: h for (k, i), h in fetched.items() if k == level})
            self.levels.append({i: joined(*(here[c] for c in (2 * i, 2 * i + 1) if c < width)) for i in path})
            width = (width + 1) >> 1

    def proof(self, place: int) -> list[tuple[bool, bytes | None]]:
        """From the leaf up, for each level: whether the node is a right child, and its sibling, if any."""
        return [(bool(place >> k & 1), self.levels[k].get(place >> k ^ 1)) for k in range(self.depth)]

    def root(self) -> bytes:
        return self.levels[-1][0]


def folded(digest: bytes, proof: list[tuple[bool, bytes | None]]) -> bytes:
    """The root that a leaf and its proof give."""
    for right, sibling in proof:
        digest = joined(digest) if sibling is None else joined(sibling, digest) if right else joined(digest, sibling)
    return digest


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (grp, leaf and others; staged) with place, their place in the group, and total, the group's size."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *order, "leaf")]
    rows = rows.withColumn("__n", F.monotonically_increasing_id())
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, *keys, F.col("__n")).sortWithinPartitions(*keys, "__n").drop("__n")
    ranged = stage(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()), "merkle-ranged")
    runs = ranged.groupBy("grp", "__part").agg(F.min("__seq").alias("__first"), F.count("*").alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy("grp").orderBy("__part")) - F.col("__rows")
    runs = runs.select("grp", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__rows").over(Window.partitionBy("grp")).alias("total"))
    out = ranged.join(small(stage(runs, "merkle-runs")), ["grp", "__part"])
    return out.withColumn("place", F.col("__seq") + F.col("__shift")).drop("__part", "__seq", "__shift")


def _climb(whole: bool) -> Callable[[pa.Table], pa.Table]:
    """The nodes above those of one part, up to its top: all of them with the given ones, or the top only."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("idx")
        grp, level, total = t["grp"][0].as_py(), t["level"][0].as_py(), t["total"][0].as_py()
        idx, nodes = t["idx"][0].as_py(), [h.encode() for h in t["hash"].to_pylist()]
        deep, rows = depth(total), []
        for k in range(level, min(level + LEVELS, deep) + 1):
            if whole and k > level or k == min(level + LEVELS, deep):
                rows += [(grp, k, idx + i, total, h.decode(), deep - k) for i, h in enumerate(nodes)]
            nodes, idx = parents(nodes), idx >> 1
        return pa.table(list(map(list, zip(*rows))), schema=pa.schema([("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("total", pa.int64()), ("hash", pa.string()), ("above", pa.int32())]))

    return run


def nodes(leaves: DataFrame) -> DataFrame:
    """The nodes at and above the tops of the parts of leaves (placed). above is 0 for a root."""
    part = F.shiftright("idx", LEVELS)
    first = leaves.select("grp", F.lit(0).alias("level"), F.col("place").alias("idx"), "total", F.col("leaf").alias("hash"))
    tops = stage(first.groupBy("grp", part.alias("part")).applyInArrow(_climb(False), NODE), "merkle-tops")
    found = [tops]
    while tops.filter("above > 0").take(1):  # a round for each factor of 2**LEVELS
        more = stage(tops.filter("above > 0").groupBy("grp", part.alias("part")).applyInArrow(_climb(True), NODE), "merkle-nodes")
        found.append(more)
        # the tops of this round: roots, and the nodes LEVELS above those of the round before
        tops = more.filter((F.col("above") == 0) | (F.col("level") == LEVELS * len(found)))
    return reduce(DataFrame.unionByName, found)


def fetched(leaves_total: DataFrame, tree: DataFrame) -> DataFrame:
    """grp, part and fetched (level, idx, hash) of every part of leaves. leaves_total: grp and total, once a group."""

    def wanted(batches):
        for b in batches:
            for grp, total, part in zip(*(c.to_pylist() for c in b.columns)):
                need = missing(np.arange(part << LEVELS, min(total, part + 1 << LEVELS)), total)
                yield pa.record_batch([pa.array([grp] * len(need), pa.string()), pa.array([part] * len(need), pa.int64()), pa.array([k for k, _ in need], pa.int32()), pa.array([i for _, i in need], pa.int64())], names=["grp", "part", "level", "idx"])

    parts = leaves_total.select("grp", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("total") - 1, LEVELS))).alias("part"))
    need = parts.mapInArrow(wanted, "grp string, part long, level int, idx long")
    got = need.join(tree.select("grp", "level", "idx", "hash"), ["grp", "level", "idx"]).groupBy("grp", "part").agg(F.collect_list(F.struct("level", "idx", "hash")).alias("fetched"))
    return stage(parts.select("grp", "part").join(got, ["grp", "part"], "left"), "merkle-fetched")


def _known(t: pa.Table, more: pa.Table) -> tuple[list[int], list[bytes], Known, dict]:
    row = more.to_pylist()[0]
    places, leaves = t["place"].to_pylist(), [h.encode() for h in t["leaf"].to_pylist()]
    return places, leaves, Known(t["total"][0].as_py(), places, leaves, {(f["level"], f["idx"]): f["hash"].encode() for f in row["fetched"] or ()}), row


def _top(t: pa.Table, more: pa.Table) -> pa.Table:
    places, _, known, _ = _known(t, more)
    proofs = [[{"right": r, "hash": s.decode() if s else None} for r, s in known.proof(p)] for p in places]
    return pa.table([t["name"].to_pylist(), t["leaf"].to_pylist(), [known.root().decode()] * len(places), proofs], schema=pa.schema([("name", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("up", pa.list_(pa.struct([("right", pa.bool_()), ("hash", pa.string())])))]))


def manifest(leaves: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of placed leaves: the nodes of every group's tree from the tops of parts on; the size of each group; and for each group
    (name) its subroot, the root, and up, the proof of the subroot below the root."""
    tree = nodes(leaves)
    sizes = stage(leaves.select("grp", "total").distinct(), "merkle-sizes")
    subroots = stage(tree.filter("above = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("hash").alias("leaf")), "merkle-subroots")
    top = placed(subroots, ["name"])
    more = fetched(top.select("grp", "total").distinct(), nodes(top))
    part = F.shiftright("place", LEVELS).alias("part")
    up = top.groupBy("grp", part).cogroup(more.groupBy("grp", "part")).applyInArrow(_top, "name string, subroot string, root string, up array<struct<right:boolean,hash:string>>")
    return tree, sizes, stage(up, "merkle-up")


def proofs(leaves: DataFrame, finish: Callable, schema: str, keep: list[str]) -> DataFrame:
    """finish(row, proof, subroot, root) of every placed leaf, after the kept columns. row: the kept columns and leaf; proof:
    all levels from the leaf to the root."""
    tree, sizes, up = manifest(leaves)
    more = fetched(sizes, tree).join(small(up.withColumnRenamed("name", "grp")), "grp").select("grp", "part", "fetched", "subroot", "root", "up")
    out = leaves.select(*keep).schema
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out)

    def expand(t: pa.Table, m: pa.Table) -> pa.Table:
        places, digests, known, row = _known(t, m)
        above = [(s["right"], s["hash"].encode() if s["hash"] else None) for s in row["up"]]
        cols = t.select(keep)
        made = [finish(dict(zip(keep, values)), d, known.proof(p) + above, row["subroot"], row["root"]) for p, d, values in zip(places, digests, zip(*(c.to_pylist() for c in cols.columns)))]
        for name, values in zip((f.split()[0] for f in schema.split(", ")), zip(*made)):
            cols = cols.append_column(name, pa.array(values))
        return cols

    part = F.shiftright("place", LEVELS).alias("part")
    rows = leaves.select("grp", "place", "total", "leaf", *[c for c in keep if c not in ("grp", "place", "total", "leaf")])
    return rows.groupBy("grp", part).cogroup(more.groupBy("grp", "part")).applyInArrow(expand, f"{kinds}, {schema}")


def steps(row: dict, digest: bytes, proof: list, subroot: str, root: str) -> tuple:
    """A proof as data, for proofs(): subroot, root and the steps up."""
    return subroot, root, [{"hash": s.decode() if s else None, "right": r} for r, s in proof]


STEPS = "subroot string, root string, steps array<struct<hash:string,right:boolean>>"


def audit(row: dict, digest: bytes, proof: list, subroot: str, root: str) -> tuple:
    """For proofs() with a kept column claimed: the digest of the siblings, the root that the claimed leaf gives, and whether
    it is the root."""
    up = folded(row["claimed"].encode(), proof).decode()
    return subroot, root, sha256(b"".join(s for _, s in proof if s)).hexdigest(), up, up == root


AUDIT = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
