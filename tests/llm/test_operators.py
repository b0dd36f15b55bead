"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows, and ties."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioloom.llm import jaccard, langid, licenses, mixing, packing, passages, quality, secrets, substring_dedup, suffix_dedup, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, size string, n string"


def corpus():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = prose(80)
    rows = []
    for i in range(60):
        t = prose(r.randint(1, 160))
        if i % 4 == 0:
            t = f"{t} {shared[: r.randint(100, len(shared))]}\n{prose(30)}"
        rows.append((i, t, "xy"[i % 2], f"s{i % 3}" if i % 7 else None))
    base = prose(120).split()
    for i in range(60, 75):  # near copies
        w = list(base)
        w[r.randrange(120)] = "Changed"
        rows.append((i, " ".join(w), "x", "s1"))
    rows += [(75, None, None, None), (76, "", "x", "s9"), (77, " \n\t", "y", "s9"), (None, prose(70), "x", "s0"), (None, None, None, "s0")]
    rows += [(78, "aa " * 300, "x", "s0"), (79, "é" * 90 + " ß𝒳 " * 40, "y", "s0"), (5, rows[5][1], "x", "s0"), (80, rows[5][1], "x", "s0")]
    return [(*x, "extra", "clash") for x in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered_documents(docs):
    """(id, text) once each, nulls first, in the order that the operators use."""
    rows = {(r.doc_id, r.text or "", r.h) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    return [(i, t) for i, t, _ in sorted(rows, key=lambda x: (-1 if x[0] is None else x[0], x[2]))]


def word_removal(rows, n=50):
    first, out = {}, {}
    for i, t in rows:
        w = WORD.findall(t)
        for k in range(len(w) - n + 1):
            first.setdefault(tuple(w[k : k + n]), i)
    for i, t in rows:
        w = WORD.findall(t)
        gone = np.zeros(len(w), dtype=bool)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] != i:
                gone[k : k + n] = True
        out[i, t] = " ".join(x for x, g in zip(w, gone) if not g)
    return out


def removed_by_place(gone):
    """Number of removed tokens and of their maximal runs."""
    return int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())


@pytest.mark.parametrize("hot,common", [(1000, 20), (1, 20), (1000, 2)])
def test_suffix_dedup(docs, monkeypatch, hot, common):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "COMMON", common)
    rows, seen, want = ordered_documents(docs), set(), set()
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        want.add((i, len(b), *removed_by_place(gone), hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()))
    got = suffix_dedup.dedup(docs, finish=suffix_dedup.digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    assert {tuple(r) for r in got} == want and len(got) == docs.count() and sum(x[2] for x in want) > 1000


@pytest.mark.parametrize("hot,common", [(1000, 20), (1, 20), (1000, 2)])
def test_substring_dedup(docs, monkeypatch, hot, common):
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "COMMON", common)
    kept = word_removal(ordered_documents(docs))
    want = {(i, len(WORD.findall(t)), len(WORD.findall(t)) - len(x.split(" ") if x else []), hashlib.sha256(x.encode()).hexdigest()) for (i, t), x in kept.items()}
    got = substring_dedup.dedup(docs, finish=substring_dedup.digest, schema="n_words long, n_removed long, kept_sha256 string").collect()
    assert {tuple(r) for r in got} == want and len(got) == docs.count() and sum(x[2] for x in want) > 100


def test_passages_without_repeats_stay(spark):
    """One phrase in many surroundings: nothing of 100 bytes or 50 words repeats."""
    phrase = " ".join(f"common{k}" for k in range(20))
    side = lambda name: F.concat_ws(" ", *[F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit(f"{name}{k}"))), 1, 5) for k in range(34)])
    docs = spark.range(60_000).withColumnRenamed("id", "doc_id").select("doc_id", F.concat_ws(" ", side("a"), F.lit(phrase[:40]), side("b")).alias("text"))
    out = suffix_dedup.dedup(docs, finish=suffix_dedup.digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert out.agg(F.sum("n_removed")).first()[0] == 0
    docs = docs.select("doc_id", F.concat_ws(" ", side("a"), F.lit(phrase), side("b")).alias("text")).filter("doc_id < 20000")
    out = substring_dedup.dedup(docs, finish=substring_dedup.digest, schema="n_words long, n_removed long, kept_sha256 string")
    assert out.agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("letters", [1, 2, 40])
def test_suffix_family_finds_every_earlier_window(letters):
    """Overlapping contexts of random documents in batches of several sizes, against all windows in their places."""
    r, w, k = np.random.default_rng(letters), 12, 4
    parts = [bytes(r.integers(0, letters, int(r.integers(1, 30)), dtype=np.uint8)) for _ in range(12)]
    contexts, first = [], {}
    for doc in range(60):
        text = b"".join(parts[i] for i in r.integers(0, len(parts), 4))
        for s in range(len(text) - w + 1):
            first.setdefault(text[s : s + w], (doc, s))
        for p in range(0, len(text) - k + 1, 3):
            left = min(w - k, p)
            contexts.append((doc, p, left, text[p - left : p + w]))
    family, a = suffix_dedup.SuffixFamily(passages.Tokens(w, k, 1, None, None)), 0
    while a < len(contexts):
        some = contexts[a : a + int(r.integers(1, 90))]
        doc, pos, left = (np.array([c[i] for c in some]) for i in range(3))
        found, lo, hi = family.add(doc, doc, pos, left, [c[3] for c in some])
        got = {int(i): (int(x), int(y)) for i, x, y in zip(found, lo, hi)}
        for i, (d, p, n, data) in enumerate(some):
            again = [s - n for s in range(len(data) - w + 1) if first[data[s : s + w]] < (d, p - n + s)]
            assert got.get(i) == ((again[0], again[-1]) if again else None)
        a += len(some)
    held = [key for level in family.levels for key in level.keys().tolist()]
    sizes = [len(level.at) for level in family.levels]
    assert len(held) == len(set(held)) == len({key.rstrip(b"\0") for key in first}) and all(x > y for x, y in zip(sizes, sizes[1:]))
    assert all((level.keys()[1:] > level.keys()[:-1]).all() for level in family.levels)


def test_passages_of_empty_tables(empty):
    assert suffix_dedup.dedup(empty).count() == 0 and substring_dedup.dedup(empty).count() == 0


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def united(names, links):
    top = {i: i for i in names}

    def find(x):
        return x if top[x] == x else find(top[x])

    for i, j in links:
        x, y = find(i), find(j)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in names}


@pytest.mark.parametrize("block", [2000, 3])
def test_jaccard(docs, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    # a row without an id is a document by its text, behind all that have one
    sets = [(10**9 + hash(r.text) % 10**9 if r.doc_id is None else r.doc_id, shingle_set(r.text)) for r in docs.collect()]
    top = united({i for i, _ in sets}, [(i, j) for i, a in sets for j, b in sets if alike(a, b)])
    named = lambda i: i if i < 10**9 else None
    want = sorted(((named(i), len(s), named(top[i])) for i, s in sets), key=str)
    got = jaccard.link(docs).collect()
    assert sorted(((r.id, r.n, r.component) for r in got), key=str) == want


def test_jaccard_links_through_a_row_without_id(spark):
    w = [f"w{k}" for k in range(120)]
    left, middle, right = w[:100], w[7:107], w[14:114]  # neighbours are alike, the outer two are not
    sets = [shingle_set(" ".join(x)) for x in (left, middle, right)]
    assert alike(sets[0], sets[1]) and alike(sets[1], sets[2]) and not alike(sets[0], sets[2])
    rows = [(9, " ".join(left)), (None, " ".join(middle)), (1, " ".join(right)), (None, "nothing like the others is here at all"), (None, None)]
    got = {(r.id, r.component) for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(9, 1), (None, 1), (1, 1), (None, None)}


def test_jaccard_candidates_do_not_grow_with_the_square_of_a_group(spark):
    """Sets that share three quarters of their n-grams never link; their pairs stay in their tasks."""
    r = random.Random(3)
    shared = [f"s{k}" for k in range(604)]
    made = {}
    for n in (100, 200, 400):
        rows = [(i, " ".join(shared + [f"x{i}_{r.random()}" for _ in range(100)])) for i in range(n)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumnRenamed("doc_id", "id")
        full = jaccard.stage(jaccard.features(df, jaccard.frequent(df)), "t")
        nodes = full.select("id", "n", "prefix", F.col("id").alias("label"))
        members = jaccard.prefix_members(nodes).count()
        made[n] = members, jaccard.prefix_pairs(nodes, full.select("id", "bitmap")).count()
    assert all(pairs == 0 for _, pairs in made.values()) and made[400][0] <= 4.4 * max(made[100][0], 1)


def test_keep_first(docs):
    rows = {(r.doc_id, r.text, r.h) for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[2]))
    sets = [shingle_set(t) for _, t, _ in rows]
    top = united(range(len(rows)), [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if alike(a, b)])
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((rows[i][:2] for i in top if top[i] == i), key=str)
    once = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    assert {r.doc_id for r in jaccard.keep_first(once).collect()} == {r.component for r in jaccard.link(once).collect()}


def test_group_pairs_of_large_and_small_groups():
    r = np.random.default_rng(2)
    g = np.sort(np.concatenate((np.zeros(400, dtype=np.int64), r.integers(1, 200, 900))))
    n, side, label = r.integers(40, 70, len(g)), r.integers(0, 3, len(g)), np.where(r.random(len(g)) < 0.6, 0, r.integers(0, 9, len(g)))
    pos, ids = r.integers(0, 12, len(g)), np.arange(len(g))
    ok = lambda i, j: g[i] == g[j] and label[i] != label[j] and (side[i] == 0 or side[i] != side[j]) and min(n[i] - pos[i], n[j] - pos[j]) >= jaccard.needed(n[i], n[j])
    small_first = lambda i, j: (i, j) if (n[i], i) <= (n[j], j) else (j, i)
    want = {frozenset((i, j)) for i in ids for j in ids[i + 1 :] if g[i] == g[j] and ok(*small_first(i, j)) and ok(*reversed(small_first(i, j)))}
    got = {frozenset(p) for a, b in jaccard.group_pairs(g, side, n, pos, ids, label) for p in zip(a.tolist(), b.tolist())}
    maybe = {frozenset((i, j)) for i in ids for j in ids[i + 1 :] if g[i] == g[j] and (ok(i, j) or ok(j, i))}
    assert want <= got <= maybe and len(want) > 100


def test_trie_join_finds_every_link():
    r = np.random.default_rng(1)
    base = np.unique(r.integers(0, 1 << 40, 200, dtype=np.uint64))
    partners = [np.unique(np.concatenate((base[: len(base) - k], r.integers(0, 1 << 40, k // 2, dtype=np.uint64)))) for k in range(0, 120, 3)]
    want = [i for i, p in enumerate(partners) if 100 * len(np.intersect1d(base, p)) >= 80 * len(np.union1d(base, p))]
    assert sorted(jaccard.trie_join(base, partners, step=7)) == want and 0 < len(want) < len(partners)


def test_secrets(spark):
    rows = [(1, "user: bob_x password = \"hunter22\" at https://a.b/c?x=1 token=token=abcdef aPi_KeY:zzzzzz"), (2, "token:token:abcdefg AKIA" + "A" * 16 + " AKIAabc"), (3, "é𝒳 https://x.y/z alone"), (4, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.s for r in secrets.spans(df).select(F.col("kept.doc_id").alias("id"), secrets.joined(F.col("spans")).alias("s")).collect()}
    assert got == {1: "login:0:11,assign:12:32,endpoint:37:54,assign:55:73,assign:74:88", 2: "access:20:40", 3: "", 4: "", None: ""}
    assert sorted(r.text or "" for r in secrets.redacted(df).collect())[-1].startswith("é𝒳")


def brute_base(text):
    """The base spans by Python's re, from the words of the contract."""
    found = []
    for m in re.finditer(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        found += [(m.start(), 1, "assign", m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 2, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    return sorted(found + [(m.start(), 3, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24])


def brute_spans(text):
    base = brute_base(text)
    weak = [(m.start(), n, k, m.end()) for k, n, _, p, h in secrets.KINDS[3:] for m in re.finditer(p, text) if k != "opaque" or all(re.search(c, m[0]) for c in ("[0-9]", "[a-z]", "[A-Z]"))]
    owners = [w for w in weak if w[2] in ("login", "endpoint")]
    weak = [w for w in weak if w[2] != "opaque" or not any(o[0] < w[3] and w[0] < o[3] for o in owners)]
    role = {k: r for k, _, r, _, _ in secrets.KINDS}
    every, out = sorted(base + weak), list(base)
    for s in weak:
        if any(b[0] < s[3] and s[0] < b[3] for b in base):
            continue
        gap = lambda x: x[0] - s[3] if x[:2] > s[:2] else s[0] - x[3]
        if any(x != s and role[x[2]] in secrets.COMPLETES[role[s[2]]] and gap(x) <= secrets.REACH for x in every):
            out.append(s)
    return sorted(out)


def secret_texts():
    r = random.Random(6)
    bits = ["password = \"hunter22x\"", "token:abc", "Api_KEY='zzzz.zzzz'", "AKIA" + "Q7" * 8, "AKIASHORT", "deadbeef" * 4, "0123456789abcdef", "user_name: bob", "https://h.example/p?q=1", "Zm9vYmFyMTIz" * 3, "é𝒳ß", "secret=secret=secret99", "client_id=3MVG9lKcPoNINVBIPJjdw1J9LLM", "https://Example.com/News/2024/Some-Long-Article-Title-Here", "\x00", "plain words here", "x" * 230]
    return ["".join(r.choice(bits) + r.choice([" ", "\n", ",", ""]) for _ in range(r.randint(0, 12))) for _ in range(200)] + [None, "", "é" * 50]


def test_one_string_is_not_two_parts(spark):
    mixed = "Zm9vYmFyMTIz" * 3
    rows = [
        (1, "see https://Example.com/News/2024/Some-Long-Article-Title-Here for more"), (2, "client_id=3MVG9lKcPoNINVBIPJjdw1J9LLM"), (3, f"client_id=3MVG9lKcPoNINVBIPJjdw1J9LLM and {mixed}"),
        (4, f"https://Example.com/News/2024/Some-Long-Article-Title-Here, {mixed}"), (5, "user: bob at https://Example.com/News/2024/Some-Long-Article-Title-Here"), (6, f"{mixed} alone"), (7, f"{mixed}{' ' * 201}user: bob"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.i: [s.kind for s in r.spans] for r in secrets.spans(df).select(F.col("kept.doc_id").alias("i"), "spans").collect()}
    assert got == {1: [], 2: [], 3: ["login", "opaque"], 4: ["endpoint", "opaque"], 5: [], 6: [], 7: []}


def test_secrets_against_brute_force(spark):
    texts = secret_texts()
    df = spark.createDataFrame([(i % 190, t, "clash", "x") for i, t in enumerate(texts)], "doc_id long, text string, row string, spans string").repartition(3)
    got = sorted((r.i, r.s) for r in secrets.spans(df).select(F.col("kept.doc_id").alias("i"), secrets.joined(F.col("spans")).alias("s")).collect())
    assert got == sorted((i % 190, ",".join(f"{k}:{a}:{z}" for a, _, k, z in brute_spans(t or ""))) for i, t in enumerate(texts))
    want = []
    for i, t in enumerate(texts):
        at, out = 0, ""
        for a, _, _, z in brute_spans(t or ""):
            if a >= at:
                out += t[at:a] + "[SECRET]"
            at = max(at, z)
        want.append((i % 190, None if t is None else out + t[at:], "clash", "x"))
    assert sorted(map(tuple, secrets.redacted(df).collect()), key=str) == sorted(want, key=str)
    assert secrets.spans(df.limit(0)).count() == 0 and secrets.redacted(df.limit(0)).columns == df.columns


def test_many_secrets_in_one_text(spark):
    text = "token = abcdef1 and then some words " * 40_000
    df = spark.createDataFrame([(1, text), (2, "no secrets")], "doc_id long, text string")
    assert sorted(r.n for r in secrets.spans(df).select(F.size("spans").alias("n")).collect()) == [0, 40_000]


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count() and all(r.taken <= 3 * r.size for r in rows)
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)
    assert abs(sum({r.source: r.target for r in rows}.values()) - sum(r.size for r in rows)) < 1e-6
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns and mixed.select(F.sum(F.length("text"))).first()[0] > 0
    assert mixing.mix(empty).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=4).round(1)]) for i in range(300)] + [(300, None), (301, [1.0, float("nan"), 0.0, 0.0]), (302, [0.0] * 4), (303, [0.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ok = {i: np.floor(256 * np.float32(v).astype(float)).astype(int) for i, v in rows if v and not np.isnan(v).any()}
    want = []
    for q in (i for i in ok if i % 50 == 0):
        best = sorted((-int(ok[q] @ x), i) for i, x in ok.items() if i != q)[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(map(tuple, topk.search(df.filter("vec_id % 50 = 0"), df).collect())) == sorted(want)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_packing_plan_fills_bins():
    r = random.Random(2)
    counts = {n: r.randint(0, 4) for n in range(1, 4097)}
    bins = {}
    for length, first, number, b, offset in packing.plan({k: v for k, v in counts.items() if v}):
        for k in range(number):
            bins.setdefault(b + k, []).append((offset, length))
    placed = [x for v in bins.values() for _, x in v]
    assert sorted(placed) == sorted(n for n, c in counts.items() for _ in range(c))
    for v in bins.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= 1.03 * sum(placed) / 4096


def test_packing_round_trip(docs):
    path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(t.encode(r.text or "", add_special_tokens=False).ids + [1], dtype="<u4").tobytes()) for r in docs.collect())
    got = packing.pack(docs, path).collect()
    assert sorted(r.ids_crc32 for r in got) == want


def test_language(docs, empty):
    models = {"a": langid.train(["the cat sat on the mat " * 20]), "b": langid.train(["der hund lag auf dem weg " * 20])}
    assert langid.entropies(models, ["the mat sat", "auf dem weg"]).argmin(axis=1).tolist() == [0, 1]
    rows = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert rows[75].lang_pred == rows[77].lang_pred == "und" and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.identify(empty).count() == 0


def test_language_limits_withstand_junk_labels(spark):
    r = random.Random(9)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(60)]
    junk = lambda: " ".join("".join(r.choice("qwrtzpkjvxy") for _ in range(6)) for _ in range(40))
    rows = [(i, junk() if i % 10 == 0 else " ".join(r.choice(vocab) for _ in range(60)), "a") for i in range(800)]
    rows += [(2000 + i, junk(), None) for i in range(40)]
    got = {r.doc_id: r.rejected for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()}
    held = [i for i in range(800) if zlib.crc32(str(i).encode()) % 4 == 2 and i % 10]
    assert sum(got[2000 + i] for i in range(40)) >= 38 and sum(got[i] for i in held) <= 0.02 * len(held)


def test_probabilities_sum_to_one():
    text = "abracadabra barbara cab " * 5
    m = langid.train([text])
    letters = sorted(set(text))
    context = langid.symbols("abr")
    total = 0.0
    for c in letters:
        a = np.concatenate((context, langid.symbols(c)))
        total += 2 ** langid.log_probabilities(m, langid.grams(a), langid.contexts(a))[0]
    assert 0.8 < total <= 1.0001


def test_quality(docs, empty):
    for r in docs.collect():
        t = r.text or ""
        w = WORD.findall(t)
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        n, chars, _, d, rep, failed, kept, *_ = quality.judge(t, None)
        assert (n, chars, d, rep) == (len(w), sum(map(len, w)), dup, len(twice)) and failed == (n < 50 or 100 * rep > 50 * n) and kept == (not failed)
    assert quality.rules(docs).count() == docs.count() and quality.rules(empty).count() == 0


def clean_and_junk(r, n):
    common, long = ["the", "of", "and", "to", "in", "is", "it", "was"], "abcdefghijklmnop"
    word = lambda: "".join(r.choice(long) for _ in range(9))
    clean = [" ".join(r.choice(common) if r.random() < 0.4 else word() for _ in range(150)) for _ in range(n)]
    return clean, [" ".join(word() for _ in range(150)) for _ in range(n // 5)]


def test_quality_rejects_text_without_common_words(spark):
    clean, junk = clean_and_junk(random.Random(7), 100)
    rows = [(i, t, "en") for i, t in enumerate(clean)] + [(1000 + i, t, "en" if i % 2 else None) for i, t in enumerate(junk)]
    got = quality.rules(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)).collect()
    assert not any(r.kept for r in got if r.id >= 1000) and not any(r.base_failed for r in got)
    assert sum(r.kept for r in got if r.id < 1000) >= 98


def test_quality_judges_both_histograms_against_one_language():
    rows = [("a", "class", "0", 9, 10), ("a", "class", "7", 1, 10), ("a", "word", "aa", 5, 10), ("a", "word", "", 5, 10)]
    rows += [("b", "class", "1", 9, 10), ("b", "class", "7", 1, 10), ("b", "word", "bb", 5, 10), ("b", "word", "", 5, 10)]
    refs = quality.References(pd.DataFrame(rows, columns=["lang", "kind", "item", "n", "total"]))
    *_, c, w, near, own_c, own_w = quality.judge("bb cccccccc bb dddddddd", refs, "a")  # letters as in a, words as in b
    assert max(c, w) > 0.5 and near in "ab" and (own_c, own_w)[near == "a"] is not None
    got = refs.word_distances({"aa": 1, "BB": 2, "x": 1}, 4)
    want = [quality.distance(np.array([0.25, 0.75]), np.array([[0.5, 0.5]]))[0], quality.distance(np.array([0.5, 0.5]), np.array([[0.5, 0.5]]))[0]]
    assert np.allclose(got, want)


def test_quality_keeps_documents_of_every_language(spark):
    r = random.Random(8)
    word = lambda a: "".join(r.choice(a) for _ in range(r.randint(2, 8)))
    latin, hebrew = "abcdefgh", "".join(map(chr, range(0x5D0, 0x5EA)))
    rows = [(f"l{k}", " ".join(word(latin) for _ in range(70))) for k in range(401) for _ in range(20)]
    rows += [("he", " ".join(word(hebrew) for _ in range(52))) for _ in range(22)] + [("few", " ".join(word(hebrew[:9]) for _ in range(52)))]
    df = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    got = {r.id: r for r in quality.rules(df).collect()}
    assert len(got) == len(rows) and sum(got[i].kept for i, (x, _) in enumerate(rows) if x == "he") >= 21
    assert all(got[i].kept for i, (x, _) in enumerate(rows) if x == "few")


def test_license_bodies_and_wordings(spark):
    rows = [(1, "some words before " + licenses.TEMPLATES["gpl-2.0"]), (2, licenses.TEMPLATES["isc"] + " and after"), (3, "It is licensed under the MIT License, too"), (4, "under the ISC")]
    found = {(r.id, r.license) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found >= {(1, "gpl-2.0"), (2, "isc"), (3, "mit-licensed")} and not any(i == 4 for i, _ in found)


def test_band_keys_retrieve_among_many_templates(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    many = {f"t{k}": " ".join(word() for _ in range(r.choice([8, 20, 40]))) for k in range(700)}
    near = {k: many[k].split() for k in ("t3", "t77", "t500")}
    rows = [(i, " ".join([*(word() for _ in range(30)), *w, *(word() for _ in range(30))])) for i, w in enumerate(near.values())]
    rows += [(10, many["t9"] + " " + many["t10"]), (11, " ".join(word() for _ in range(300))), (12, None)]
    found = {(x.id, x.license) for x in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), many).collect()}
    assert found == {(0, "t3"), (1, "t77"), (2, "t500"), (10, "t9"), (10, "t10")}


def test_license_bands_reach_the_stated_recall():
    for text in licenses.TEMPLATES.values():
        t = len(set(zip(*(licenses.words_of(text)[k:] for k in range(licenses.N)))))
        window = 2 * licenses._class(t)
        assert (1 - licenses.CONTAINED * t / (window + (1 - licenses.CONTAINED) * t)) ** licenses.BANDS <= 0.0003


def test_license_scan_finds_all_placements(spark):
    r = random.Random(4)
    header = licenses.words_of(licenses.TEMPLATES["apache-2.0-header"])
    filler = lambda n: ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(1500):
        copy = ["other", *header[1:-1], "other"] if i % 2 else header
        rows.append((i, " ".join([*filler(r.randint(0, 90)), *copy, *filler(60)])))
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert found.filter("license = 'apache-2.0-header'").count() >= 1499


def test_licenses(spark):
    df = spark.createDataFrame([(1, "x y z\nReleased under the MIT License. more"), (2, "Licensed*** under the Apache License, Version 2.0"), (3, "no license here at all"), (4, None)], "doc_id long, text string")
    assert sorted((r.id, r.license) for r in licenses.scan(df).collect()) == [(1, "mit-statement"), (2, "apache-2.0-statement")]


def test_blocks_of_near_vectors_are_skipped():
    """Vectors in tight groups, ids by group: most blocks are never scored, and the results are those of all products."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 32)) * 300
    x = np.floor(np.repeat(centres, 64, axis=0) + r.normal(size=(40 * 64, 32)) * 10).astype(np.int64)
    q = x[::100]
    at, ids, scores, scored = topk.search_cell(np.arange(len(x))[::100], q, np.arange(len(x)), x, 5, block=64)
    assert scored < 0.2 * len(q) * 40
    for k in range(len(q)):
        s = np.delete(x @ q[k], 100 * k)
        assert sorted(scores[at == k].tolist(), reverse=True) == sorted(s.tolist(), reverse=True)[:5]


def test_mix_of_one_id(spark):
    rows = [(None, f"{'word ' * 9}{i}", "a") for i in range(400)] + [(1, f"{'word ' * 9}{i}", "b") for i in range(400)] + [(i, "some few words", "c") for i in range(100)]
    rows = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10
