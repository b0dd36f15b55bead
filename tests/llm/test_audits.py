"""Divergence audit, quality classifier and Merkle manifest against brute force, on small tables with nulls, empty and
repeated rows, ties, long texts and clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioloom.llm import divergence, merkle, nbsvm, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, grp string, __y int, cells string"


def rows():
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(60)] + ["Éte", "straße", "日本", "ÀB"]
    out = []
    for i in range(150):
        t = " ".join(r.choice(vocab) for _ in range(r.randint(1, 40))) + r.choice(["", "!", " 12 A_b", "\n\tX"])
        out.append((i, t, ["en", "de", "x", None][i % 9 % 4], [f"s{i % 5}", None, ""][i % 11 // 5 if i % 3 else 0], r.choice([None, i, len(t)])))
    out += [(150, None, "en", "s1", None), (151, "", "none", "a", 0), (152, "1 2 3", "none", "b", 5), (153, "1", "alone", None, 1), (None, "null id", "en", "s0", 7), (None, None, None, None, None)]
    out += [out[3], out[3], (3, "other text of three", *out[3][2:]), (154, "Zz " * 60_000 + "q" * 100_000, "en", "long", 9), (2**62, "big", "de", "s0", 2**63 - 1), (-7, "minus", "de", "s0", -1)]
    return [(*x, "c", "c", 1, "c") for x in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def expected_divergences(data, least):
    df, n, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source, *_ in data:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        groups[lang].add(source)
        df[lang].update(set(terms))
        n[lang, source].update(terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, c in df[lang].items() if c >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        share = lambda c, size: 1 + 10**9 * (c + 2) // (size + 2 * len(kept))
        gap = lambda p, q: (p - q) ** 2 // (p + q)
        p = {(s, t): share(n[lang, s][t], total[s]) for s in sources for t in kept}
        q = {t: share(sum(n[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = sorted((-sum(gap(p[s, t], p[o, t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-gap(p[s, t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s, t] > q[t])[:10]
            out |= {(lang, s, part, o.decode(), -v, k + 1) for part, got in (("pair", pairs), ("term", terms)) for k, (v, o) in enumerate(got)}
    return out


@pytest.mark.parametrize("cells,dense,chunk", [(200_000, 1 << 20, 1 << 16), (40, 8, 16)])
def test_divergences(docs, empty, monkeypatch, cells, dense, chunk):
    monkeypatch.setattr(divergence, "CELLS", cells)
    monkeypatch.setattr(divergence, "DENSE", dense)
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    for least in (10, 1, 10**6):
        got = divergence.audit(docs, least=least).collect()
        want = expected_divergences(rows(), least)
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert divergence.audit(empty).count() == 0


def test_spills_do_not_change_stripes():
    """Folding with a spill after every text gives the same sums."""
    import pyarrow as pa

    data = [(x[2] or "", x[3] or "", (x[1] or "").encode()) for x in rows()]
    batch = pa.record_batch([pa.array(c) for c in zip(*data)], names=["lang", "source", "text"])

    def sums(parts):
        df, n = Counter(), Counter()
        for b in parts:
            for r in b.to_pylist():
                df[r["lang"], r["term"]] += r["df"]
                for c in r["cells"]:
                    n[r["lang"], r["term"], c["source"]] += c["n"]
        return df, n

    whole = sums(divergence.fold(iter([batch])))
    old, divergence.CELLS = divergence.CELLS, 1
    try:
        assert sums(divergence.fold(iter([batch]))) == whole
    finally:
        divergence.CELLS = old


def test_shares_are_exact():
    r = random.Random(2)
    for _ in range(300):
        total = r.choice([2, 7, 10**6 + 3, 8 * 10**15])
        c = r.randint(1, total)
        assert divergence.shares(np.array([c]), np.array([total]))[0] == 1 + 10**9 * c // total


def classified(n, seed):
    """Clean and symbol-laden texts with their labels."""
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(400)]
    out = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 80))]
        bad = i % 5 == 0
        out.append((i, " ".join(w + r.choice(["%%%", "&&&"]) if bad else w for w in words), int(not bad)))
    return out


def test_classifier_on_held_out_rows(spark):
    data = classified(1500, 3)
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _ in data] + [(None, "a word", "x"), (9000, None, "x"), (9001, "", "x"), (9001, "", "x"), (9002, "ab " * 200_000, "x")], "doc_id long, text string, __y string").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in data] + [(None, 1), (9000, 0), (9000, 1), (9001, 7), (9002, None), (123456, 0)], "doc_id long, quality int")
    got = nbsvm.score(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    score = {r.id: r.score for r in got}
    held = [(score[i], y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 200 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.98
    assert score[9000] == score[9001]
    again = {r.id: r.score for r in nbsvm.score(docs.repartition(3), labels.repartition(2)).collect()}
    assert again == score


def test_classifier_learns_nothing_from_the_held_out_fold(spark):
    data = classified(400, 4)
    docs = spark.createDataFrame([(i, t) for i, t, _ in data], "doc_id long, text string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    schema = "doc_id long, quality int"
    one = nbsvm.score(docs, spark.createDataFrame([(i, y) for i, _, y in data], schema)).collect()
    other = nbsvm.score(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in data], schema)).collect()
    assert sorted(one) == sorted(other)


def test_classifier_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in nbsvm.score(docs, none).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1) for i in (1, 2)], "doc_id long, quality int")
    assert all(r.score > 0.5 for r in nbsvm.score(docs, ones).collect())
    assert nbsvm.score(docs.limit(0), ones).count() == 0


def test_ngrams_are_distinct_and_do_not_cross_texts():
    def brute(t):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^0-9A-Za-z\x80-\xff\t-\r ]+", t)
        return tokens

    texts = [b"a b, c", b"", None, b"a b a b", "Été été".encode(), b"x x x x", b"b, c"]
    at, n = nbsvm.ngrams(texts)
    parts = np.split(at, np.cumsum(n)[:-1])
    for t, p in zip(texts, parts):
        alone, m = nbsvm.ngrams([t])
        assert alone.tolist() == p.tolist() and m[0] == len(p) == len(set(p.tolist()))
        tokens = brute(t or b"")
        tokens = [None if k and x == tokens[k - 1] else x for k, x in enumerate(tokens)]
        assert len(p) == len(set(tokens)) + len(set(zip(tokens, tokens[1:])))


def test_dual_coordinate_descent_reaches_the_optimum():
    """No small move of the weights lowers the objective, and the duality gap is small."""
    r = np.random.default_rng(5)
    rows_ = [np.unique(r.integers(0, 30, 6)) for _ in range(80)]
    y = np.where(r.random(80) < 0.3, -1, 1)
    scale = r.normal(size=30)
    w, b = nbsvm.descend(rows_, y, scale, sweeps=500, tolerance=1e-9)
    x = np.zeros((80, 31))
    for k, i in enumerate(rows_):
        x[k, i] = scale[i] / np.linalg.norm(scale[i])
    x[:, 30] = 1
    cost = 80 / (2 * np.where(y > 0, (y > 0).sum(), (y < 0).sum()))
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best = np.append(w, b)
    assert all(loss(best) <= loss(best + d) + 1e-6 for d in r.normal(size=(300, 31)) * 0.01)


def test_log_ratios_and_curve():
    got = nbsvm.log_ratios(np.array([3, 0, 1]), np.array([0, 0, 1]))
    assert np.allclose(got, [np.log(4 / 7 / (1 / 4)), 0, np.log(2 / 7 / (2 / 4))])
    at = np.linspace(-3, 3, 61)
    p = 1 / (1 + np.exp(-(1.7 * at - 0.4)))
    a, b = nbsvm.platt(1e6 * p, 1e6 * (1 - p), at)
    assert abs(a - 1.7) < 0.01 and abs(b + 0.4) < 0.01
    assert all(map(np.isfinite, nbsvm.platt(np.zeros(3), np.zeros(3), np.arange(3.0))))


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    return [(i >> k & 1, level[i >> k ^ 1] if (i >> k ^ 1) < len(level) else None) for k, level in enumerate(levels[:-1])]


def fold(x, steps):
    for right, s in steps:
        x = h(x) if s is None else h(s, x) if right else h(x, s)
    return x


def expected_manifest(data):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda d, extra=0: h(*map(field, (d[0], d[3], d[2], d[4] if d[4] is None else d[4] + extra, d[1])))
    groups = defaultdict(list)
    for d in data:
        groups[d[2]].append(d)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d)))
    low = {g: tree([leaf(d) for d in groups[g]]) for g in names}
    high = tree([low[g][-1][0] for g in names])
    root, out = high[-1][0], []
    for k, g in enumerate(names):
        for i, d in enumerate(groups[g]):
            steps = path(low[g], i) + path(high, k)
            odd = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            up = fold(leaf(d, int(odd)), steps)
            out.append((d[0], leaf(d), low[g][-1][0], root, h(*[s for _, s in steps if s]), up, up == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("levels", [13, 1, 2, 4])
def test_manifest(spark, docs, monkeypatch, tmp_path, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in queries.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    want = expected_manifest(rows())
    assert sorted(got, key=str) == want
    assert {x[-1] for x in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 37, 64])
def test_multiproof_is_minimal_and_enough(n):
    r = random.Random(n)
    levels = tree([h(str(i)) for i in range(n)])
    for _ in range(20):
        known = sorted(r.sample(range(n), r.randint(1, n)))
        need = merkle.missing(np.array(known), n)
        # the siblings of all proofs, without what the known leaves give
        given, wanted = set(), set()
        for k, level in enumerate(levels):
            given |= {(k, i) for i in range(len(level)) if all(j in known for j in range(i << k, min(n, i + 1 << k)))}
            wanted |= {(k, i >> k ^ 1) for i in known if k < len(levels) - 1 and (i >> k ^ 1) < len(level)}
        above = {(k, i >> k) for i in known for k in range(len(levels))}  # derived from below, with what was fetched below
        assert set(need) == wanted - given - above and len(need) == len(set(need))
        got = merkle.Known(n, known, [levels[0][i].encode() for i in known], {(k, i): levels[k][i].encode() for k, i in need})
        for i in known:
            assert [(int(a), b and b.decode()) for a, b in got.proof(i)] == path(levels, i)
            assert merkle.folded(levels[0][i].encode(), got.proof(i)).decode() == levels[-1][0]
        assert got.root().decode() == levels[-1][0]


def test_proof_steps_lead_to_the_root(spark):
    rows_ = spark.range(70).select(F.when(F.col("id") % 3 > 0, F.lit("1a")).otherwise(F.lit("0")).alias("grp"), "id", F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    got = merkle.proofs(merkle.placed(rows_, ["id"]), merkle.steps, merkle.STEPS, ["id", "leaf"]).collect()
    assert len(got) == 70 and len({r.root for r in got}) == 1
    for r in got:
        assert fold(r.leaf, [(s.right, s.hash) for s in r.steps]) == r.root


def test_audits_of_empty_tables(spark, empty, tmp_path):
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for q in (queries.op11_source_divergence, queries.op12_quality_classifier, queries.op13_merkle_manifest):
        assert q(spark, str(tmp_path)).count() == 0
