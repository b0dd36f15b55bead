"""The thin queries over the operators of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, jaccard, langid, licenses, merkle, mixing, nbsvm, packing, quality, secrets, substring_dedup, suffix_dedup, topk
from .common import documents, stage


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets.spans(documents(spark, sf_dir).select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select(
        F.col("kept.doc_id").alias("doc_id"), count("assign"), count("access"), count("hex"),
        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


def _op1_sql() -> str:
    """Each kind's text is cut at its matches, which then stand in the even pieces; chr(1) marks the cuts."""
    kinds = " UNION ALL ".join(
        f"SELECT row, {number} AS number, '{kind}' AS kind, string_split(regexp_replace(t, '{pattern.replace(chr(39), chr(39) * 2)}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d"
        for kind, number, _, pattern, _ in secrets.KINDS
    )
    assign = secrets.ASSIGN.replace("'", "''")
    return rf"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
c AS ({kinds}),
u AS (SELECT row, number, kind, unnest(p) AS m, unnest(range(len(p))) AS i FROM c WHERE len(p) > 1),
e AS (SELECT *, sum(length(m)) OVER (PARTITION BY row, number ORDER BY i)::BIGINT AS z FROM u),
h0 AS (SELECT row, number, kind, z - length(m) AS a, z, CASE WHEN number <= 3 THEN number IN (1, 3) ELSE number = 5 END AS secret, number IN (2, 4) AS named, number = 6 AS endpoint
      FROM e WHERE i % 2 = 1 AND (number <> 1 OR length(regexp_extract(m, '{assign}', 2)) >= 6)
        AND (number <> 5 OR (regexp_matches(m, '[0-9]') AND regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]')))),
h AS (SELECT * FROM h0 WINDOW b AS (PARTITION BY row ORDER BY a, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), f AS (PARTITION BY row ORDER BY a, number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)
      QUALIFY number <> 5 OR NOT (coalesce(max(z) FILTER (number IN (4, 6)) OVER b > a, false) OR coalesce(min(a) FILTER (number IN (4, 6)) OVER f < z, false))),
w AS (SELECT *, coalesce(max(z) FILTER (number <= 3) OVER b > a, false) OR coalesce(min(a) FILTER (number <= 3) OVER f < z, false) AS over_base,
             coalesce(a - max(z) FILTER (secret) OVER b <= {secrets.REACH}, false) OR coalesce(min(a) FILTER (secret) OVER f - z <= {secrets.REACH}, false) AS near_secret,
             coalesce(a - max(z) FILTER (named OR endpoint) OVER b <= {secrets.REACH}, false) OR coalesce(min(a) FILTER (named OR endpoint) OVER f - z <= {secrets.REACH}, false) AS near_other
      FROM h WINDOW b AS (PARTITION BY row ORDER BY a, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    f AS (PARTITION BY row ORDER BY a, number ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
g AS (SELECT row, count(*) FILTER (number = 1) AS n1, count(*) FILTER (number = 2) AS n2, count(*) FILTER (number = 3) AS n3,
             string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) FILTER (number <= 3) AS base, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, number) AS spans
      FROM w WHERE number <= 3 OR (NOT over_base AND CASE WHEN secret THEN near_other ELSE near_secret END) GROUP BY row)
SELECT doc_id, coalesce(n1, 0)::BIGINT AS n_assign, coalesce(n2, 0)::BIGINT AS n_access, coalesce(n3, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (row)
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "size", F.col("source_size"), "target", "taken")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
                  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 9))::BIGINT AS h FROM documents),
s AS (SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k),
w AS (SELECT *, 1 + (row_number() OVER (ORDER BY k = 'n', k) - 1) % 3 AS w FROM s),
r AS (SELECT *, 3.0::DOUBLE * source_size AS most, 3.0::DOUBLE * source_size / w AS ratio FROM w),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - (sum(most) OVER (ORDER BY ratio, k) - most))
             / (sum(w::DOUBLE) OVER (ORDER BY ratio, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS lev FROM r),
g AS (SELECT arg_min(lev, struct_pack(a := ratio, b := k)) AS lev FROM l WHERE lev <= ratio),
t AS (SELECT k, source_size, coalesce(least(most, w * g.lev), most) AS target FROM l, g),
f AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS fullc FROM t),
b AS (SELECT *, CASE WHEN fullc < 3 THEN target - fullc * source_size ELSE 0 END AS rem FROM f),
v AS (SELECT k, h, sum(size) AS words FROM d GROUP BY k, h),
c AS (SELECT v.k, v.h, v.words, sum(v.words) OVER (PARTITION BY v.k ORDER BY v.h) AS cum, b.rem FROM v JOIN b USING (k)),
x AS (SELECT k, arg_min(CASE WHEN cum - rem < rem - (cum - words) THEN h ELSE h - 1 END, h) AS upto FROM c WHERE cum > rem GROUP BY k)
SELECT d.doc_id, d.size, b.source_size, b.target, (d.size * (b.fullc + CASE WHEN d.h <= coalesce(x.upto, -1) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b USING (k) LEFT JOIN x USING (k)
"""


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vecs.filter("vec_id % 50 = 0"), vecs)


OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(
        documents(spark, sf_dir), finish=suffix_dedup.digest, schema="n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
    return out.withColumnRenamed("id", "doc_id")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(documents(spark, sf_dir), finish=substring_dedup.digest, schema="n_words long, n_removed long, kept_sha256 string")
    return out.withColumnRenamed("id", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(documents(spark, sf_dir).select("doc_id", "text"), "word_bpe_49k.json")
    return out.withColumnRenamed("id", "doc_id")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = jaccard.link(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(documents(spark, sf_dir).select("doc_id", "text", "lang")).withColumnRenamed("id", "doc_id")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
x AS (SELECT row, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT row) AS df FROM x GROUP BY lang, source, term),
k AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term HAVING sum(df) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.n AS whole FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT s.*, 1 + (1000000000::HUGEINT * (s.n + 2)) // (sum(s.n) OVER (PARTITION BY s.lang, s.source) + 2 * v.v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (s.whole + 2)) // (v.total + 2 * v.v)::HUGEINT AS q FROM s JOIN v USING (lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r QUALIFY part = 'pair' OR rank <= 10
"""


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = nbsvm.score(documents(spark, sf_dir).select("doc_id", "text"), labels)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % 5 == 0, F.lit(False))
    return out.select(F.col("id").alias("doc_id"), held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    with_chars = lambda n: merkle.leaf([*map(F.col, ("doc_id", "source", "lang")), n, F.col("text")])
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    own = with_chars(F.col("n_chars"))
    claimed = F.when(tampered, with_chars(F.col("n_chars").cast("decimal(20,0)") + 1)).otherwise(own)
    leaves = stage(docs.select(merkle.group_key(F.col("lang")).alias("grp"), "doc_id", own.alias("leaf"), claimed.alias("claimed")), "merkle-leaves")
    out = merkle.proofs(merkle.placed(leaves, ["doc_id"]), merkle.audit, merkle.AUDIT, ["doc_id", "leaf", "claimed"])
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _tree_sql(name: str, of: str) -> str:
    """The nodes of the trees over of (grp, place, leaf, total), level by level, and the roots that claimed leaves fold to."""
    return f"""
{name} AS (SELECT grp, 0 AS level, place AS i, leaf AS h, total AS n FROM {of}
  UNION ALL SELECT grp, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY grp, level, i // 2, n),
{name}_path AS (SELECT o.row, string_agg(s.h, '' ORDER BY s.level) AS path FROM {of} o JOIN {name} s ON s.grp = o.grp AND s.n > 1 AND s.i = xor(o.place // (2 ** s.level)::BIGINT, 1) GROUP BY o.row)"""


def _fold_sql(name: str, tree: str, of: str) -> str:
    return f"""
{name} AS (SELECT row, grp, 0 AS level, place AS i, claimed AS h, total AS n FROM {of}
  UNION ALL SELECT f.row, f.grp, f.level + 1, f.i // 2, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), (f.n + 1) // 2
  FROM {name} f LEFT JOIN {tree} s ON s.grp = f.grp AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1)"""


def _op13_sql() -> str:
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"
    table = "list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END))"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c // 256, crc.t[xor(c, b) % 256 + 1])), 4294967295)"
    return f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {table} AS t),
a AS MATERIALIZED (SELECT row_number() OVER () AS row, coalesce('1' || lang, '0') AS grp, doc_id, {leaf("n_chars")} AS leaf,
  CASE WHEN doc_id IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("(n_chars::HUGEINT + 1)")} ELSE {leaf("n_chars")} END AS claimed FROM documents, crc),
l AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf, row) - 1 AS place, count(*) OVER (PARTITION BY grp) AS total FROM a),
{_tree_sql("low", "l")},
s AS MATERIALIZED (SELECT '' AS grp, grp AS row, h AS leaf, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS total FROM low WHERE n = 1),
{_tree_sql("high", "s")},
{_fold_sql("low_fold", "low", "l")},
u AS MATERIALIZED (SELECT f.row, '' AS grp, f.h AS claimed, s.place, s.total FROM low_fold f JOIN s ON s.row = f.grp WHERE f.n = 1),
{_fold_sql("high_fold", "high", "u")}
SELECT l.doc_id, l.leaf, s.leaf AS subroot, r.h AS root, sha256(coalesce(p.path, '') || coalesce(q.path, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
FROM l JOIN s ON s.row = l.grp JOIN high r ON r.n = 1 JOIN high_fold f ON f.row = l.row AND f.n = 1 LEFT JOIN low_path p ON p.row = l.row LEFT JOIN high_path q ON q.row = l.grp
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_mix_sources, op3_exact_top_k, op4_suffix_dedup, op5_substring_dedup, op6_license_scan, op7_best_fit_packing, op8_jaccard_join, op9_language_id, op10_quality_rules,
            op11_source_divergence, op12_quality_classifier, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": _op1_sql(), "op2_mix_sources": OP2_SQL, "op3_exact_top_k": OP3_SQL, "op11_source_divergence": OP11_SQL, "op13_merkle_manifest": _op13_sql()}
