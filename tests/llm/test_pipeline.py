"""The pipeline's stages one by one, and run() from end to end, on a small table with planted cases."""

import random
from collections import Counter
from pathlib import Path

import corpus_pipeline
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioloom.llm import langid
from folioloom.llm import queries as llm
from folioloom.llm.common import BATCH, bounded, shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows(r):
    words = {x: ["".join(r.choice(a) for _ in range(r.randint(2, 7))) for _ in range(80)] for x, a in (("a", "abcdefgh"), ("b", "nopqrstu"))}
    out = []
    for i in range(600):
        lang = "ab"[i % 2]
        out.append((i, " ".join(r.choice(words[lang]) for _ in range(60)), lang, f"s{i % 5}"))
    out += [(600 + i, out[i][1] + (" abcd" if i % 3 else ""), "a" if i % 2 == 0 else "b", "s1") for i in range(40)]  # near and exact copies
    out += [(700, None, "a", "s1"), (701, "", "a", None), (702, "12 34 ...", None, "s2"), (703, "ЖЫШ " * 60, None, "s2")]
    out += [(704, out[2][1][:120] + " password = hunter22x " + out[4][1], "a", "s3"), (705, " ".join(r.choice(words["a"]) for _ in range(9000)), "a", "s4")]
    return [(i, t, x, s, len(t or "")) for i, t, x, s in out]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    data = rows(random.Random(3))
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, data


def test_stages(spark, sf):
    path, data = sf
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    language = kept["language ID"](spark, docs, path)
    assert language.columns == COLUMNS
    ids = {r.doc_id for r in language.select("doc_id").collect()}
    assert not ids & {700, 701, 702, 703} and len(ids & set(range(640))) >= 630 and 705 in ids
    unique = kept["n-gram Jaccard join"](spark, docs, path)
    assert unique.columns == COLUMNS
    assert {r.doc_id for r in unique.select("doc_id").collect()} == {i for i, *_ in data if not 600 <= i < 640}
    clean = {r.doc_id: r for r in kept["secret scans"](spark, docs, path).collect()}
    assert len(clean) == len(data) and "hunter22x" not in clean[704].text and "[SECRET]" in clean[704].text and clean[704].n_chars == len(clean[704].text)
    assert all(clean[i].text == t for i, t, *_ in data if i != 704)
    mix = kept["mixing sources to target weights"](spark, docs, path)
    assert mix.columns == COLUMNS and max(r["count"] for r in mix.groupBy("doc_id").count().collect()) <= 3


def test_language_stage_writes_no_text(spark, sf):
    path, data = sf
    odd = [(None, data[0][1], "a", "s1", 1), (None, "ЖЫШ " * 60, None, "s2", 2), (3, "ЖЫШ " * 60, "b", None, 3), (3, None, "b", "s3", None), data[3], data[3]]
    docs = spark.createDataFrame([*data, *odd], ", ".join(f"{c} {'string' if c in ('text', 'lang', 'source') else 'long'}" for c in COLUMNS)).repartition(3)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("*"))
    got = Counter(map(tuple, corpus_pipeline.language(spark, docs, path).collect()))
    written = [f for x in shared.glob("*") if x not in before for f in x.glob("*.parquet")]
    assert not any("text" in spark.read.parquet(f"file:{f}").columns for f in written)
    assert 0 < sum(f.stat().st_size for f in written) < sum(len(t or "") for _, t, *_ in data) / 2
    # as the verdicts on the rows themselves say, rows with repeated and null ids included
    told = langid.identify(docs, keep=COLUMNS).filter("lang_pred <> 'und' and not rejected").select(COLUMNS)
    assert got == Counter(map(tuple, told.collect())) and got[data[3]] == 3 and got[odd[0]] == 1 and not any(x in got for x in odd[1:4])


def test_stages_bound_what_a_task_holds(spark, sf):
    pytest.importorskip("public_tokenizers")
    keys = ("spark.sql.execution.arrow.maxBytesPerBatch", "parquet.hadoop.vectored.io.enabled")
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcd "), 600).alias("text"), F.lit("a").alias("lang"), F.lit("s").alias("source"), F.lit(3000).cast("long").alias("n_chars"))
    docs = docs.union(spark.range(1).select(F.lit(3000).cast("long"), F.repeat(F.lit("abcd "), 1_000_000), F.lit("a"), F.lit("s"), F.lit(5_000_000).cast("long")))

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "bytes"])

    for name, apply in corpus_pipeline.STAGES:
        for key in keys:
            spark.conf.unset(key)
        apply(spark, spark.read.parquet(f"{sf[0]}/documents.parquet"), sf[0])
        got = docs.mapInArrow(sizes, "n long, bytes long").collect()
        assert sum(r.n for r in got) == 3001 and max(r.bytes for r in got if r.n > 1) < 2 * BATCH, name
        assert max(r.bytes for r in got) >= 5_000_000 and spark.conf.get(keys[1]) == "false", name  # a longer row is whole
    for key, value in zip(keys, ("5000000", "true")):  # what the session sets stays
        spark.conf.set(key, value)
    bounded(spark)
    assert [spark.conf.get(key) for key in keys] == ["5000000", "true"]
    for key in keys:
        spark.conf.unset(key)


def test_run_and_empty_tables(spark, sf, tmp_path):
    pytest.importorskip("public_tokenizers")
    got = corpus_pipeline.run(spark, sf[0]).collect()
    seen = {r.doc_id for r in got}
    assert 705 in seen and not seen & {*range(600, 640), 700, 701, 702, 703}
    assert max(r.length for r in got) <= 4096 and sum(r.doc_id == 705 for r in got) >= 2
    ends: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):  # pieces stand gapless in their sequences
        assert ends.get(r.sequence_id, 0) == r.offset
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096 and len(ends) <= 1.05 * sum(ends.values()) / 4096 + 2
    spark.read.parquet(f"{sf[0]}/documents.parquet").filter(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in llm.queries().items():
        if name != "op3_exact_top_k":
            assert query(spark, str(tmp_path)).count() == 0, name


def test_queries_have_their_columns(spark, sf):
    want = {
        "op1_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
        "op4_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
        "op5_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
        "op8_jaccard_join": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
        "op9_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
        "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    }
    for name, columns in want.items():
        got = dict(llm.queries()[name](spark, sf[0]).dtypes)
        assert {c: got.get(c) for c in columns} == columns, name


def test_language_accuracy_on_held_out_rows(spark, sf):
    out = llm.op9_language_id(spark, sf[0]).filter("held_out and doc_id < 600").select("doc_id", "lang_pred").collect()
    assert len(out) > 100 and sum(r.lang_pred == "ab"[r.doc_id % 2] for r in out) >= 0.98 * len(out)
