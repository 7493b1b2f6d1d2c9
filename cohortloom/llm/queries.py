"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom.llm import bpe, decontaminate, jaccard_join, language, licenses, line_dedup, lm_scoring, merkle, quality, ranked_search, samples, suffix_dedup, topk, toxicity
from cohortloom.llm.registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(table(spark, sf_dir, "documents", "doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


_CONTAMINATION_SQL = """
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
  FROM benchmark
), spans AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS size, unnest([array_to_string(ws[i : i + least(13, len(ws)) - 1], ' ') FOR i IN range(1, len(ws) - least(13, len(ws)) + 2)]) AS span
  FROM iw WHERE len(ws) > 0
), sizes AS (SELECT DISTINCT size FROM spans
), ds AS (
  SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS p, unnest([array_to_string(ws[i : i + size - 1], ' ') FOR i IN range(1, len(ws) - size + 2)]) AS span
  FROM dw, sizes WHERE len(ws) >= size
), hits AS (SELECT ds.doc_id, ds.p, ds.size, spans.item_id FROM ds JOIN spans ON ds.size = spans.size AND ds.span = spans.span
), words AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(p, p + size)) AS w FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(dw.ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(dw.ws) AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontamination", _CONTAMINATION_SQL)
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


@query("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())
    ids_text = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op4_license_scan")
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "licenses.n_base",
        "licenses.first_word",
        "licenses.last_word",
        F.array_join("licenses.base_labels", ",").alias("base_labels"),
        F.array_join("licenses.labels", ",").alias("labels"),
        "licenses.score",
    )


_REPEATS_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), w AS (
  SELECT doc_id, p, md5(substring(h, CAST(2 * p + 1 AS BIGINT), 200)) AS s FROM (SELECT doc_id, h, unnest(range(0, greatest(len(h) // 2 - 99, 0))) AS p FROM d)
), dup AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM w) WHERE k > 1
), marked AS (
  SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run
  FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS fresh FROM dup)
), runs AS (
  SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM marked GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
  UNION ALL
  SELECT d.doc_id, coalesce(max(b), 0), len(any_value(h)) // 2 FROM d LEFT JOIN runs USING (doc_id) GROUP BY d.doc_id
), kept AS (
  SELECT g.doc_id, string_agg(substring(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS k FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id
), n AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


@query("op5_suffix_array_dedup", _REPEATS_SQL)
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["length"]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op6_language_id")
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents", "doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


_UNITS_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(translate(coalesce(text, ''), chr(30), ' '), '([.!?][ \\t]+|\\n)', '\\1' || chr(30), 'g'), chr(30)) AS us FROM documents
), cut AS (
  SELECT doc_id, unnest(us) AS unit, generate_subscripts(us, 1) AS number FROM d
), formed AS (
  SELECT *, trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+', ' ', 'g'), ' ') AS form FROM cut
), ranked AS (
  SELECT *, len(string_split(form, ' ')) >= 12 AND row_number() OVER (PARTITION BY form ORDER BY doc_id, number) > 1 AS gone FROM formed
)
SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, CAST(coalesce(sum(length(unit)) FILTER (gone), 0) AS BIGINT) AS n_removed_chars,
  sha256(coalesce(string_agg(unit, '' ORDER BY number) FILTER (NOT gone), '')) AS kept_sha256
FROM ranked GROUP BY doc_id
"""


@query("op7_substring_dedup", _UNITS_SQL)
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = line_dedup.dedup_units(table(spark, sf_dir, "documents", "doc_id", "text"))
    removed_chars = F.aggregate("removed", F.lit(0).cast("long"), lambda total, r: total + r["length"])
    return cut.select(
        "doc_id",
        "n_units",
        F.size("removed").cast("long").alias("n_removed"),
        removed_chars.alias("n_removed_chars"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.classify(table(spark, sf_dir, "documents", "doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


_TOP_K_SQL = """
WITH ok AS (
  SELECT DISTINCT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(CAST(x AS DOUBLE))]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum([p[1] * p[2] FOR p IN list_zip(q.v, c.v)]) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op9_exact_top_k", _TOP_K_SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return topk.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


_JACCARD_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3] FOR i IN range(1, len(ws) - 2)])
  END AS shingles
  FROM w
), tok AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS t FROM s
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, a.n AS nx, b.n AS ny, count(*) AS c
  FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM common WHERE 100 * c >= 85 * (nx + ny - c)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach AS (
  WITH RECURSIVE r(a, b) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT r.a, e.y FROM r JOIN edge e ON r.b = e.x
  ) SELECT a, min(b) AS least FROM r GROUP BY a
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, reach.least AS component_id FROM s JOIN reach ON s.doc_id = reach.a
"""


@query("op10_ngram_jaccard_join", _JACCARD_SQL)
def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=4, percent=85)


@query("op11_lm_scoring")
def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


_MERKLE_SQL = """
WITH RECURSIVE d AS (
  SELECT *, row_number() OVER () AS rid, CAST(doc_id AS VARCHAR) AS k, coalesce(lang, '') AS l, lang IS NOT NULL AS has FROM documents
), bits AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, [CAST(ascii(c) AS BIGINT) FOR c IN string_split(k, '')]),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) AS crc FROM d
), f AS (
  SELECT *, coalesce(strlen(k) || ':' || k, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS front,
    coalesce(strlen(text) || ':' || text, '-') AS back,
    CAST(n_chars AS VARCHAR) AS n, CAST(CASE WHEN crc % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS VARCHAR) AS n2 FROM bits
), leaf AS (
  SELECT rid, doc_id, l, has, sha256(front || coalesce(strlen(n) || ':' || n, '-') || back) AS leaf, sha256(front || coalesce(strlen(n2) || ':' || n2, '-') || back) AS claim FROM f
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY has, l ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY has, l) AS total FROM leaf
), tree AS (
  SELECT has, l, 0 AS level, pos, total, leaf AS digest FROM placed
  UNION ALL
  SELECT a.has, a.l, a.level + 1, a.pos // 2, (a.total + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM tree a LEFT JOIN tree b ON a.has = b.has AND a.l = b.l AND b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.total > 1
), subroots AS (
  SELECT has, l, level AS top, digest AS subroot, row_number() OVER (ORDER BY has, l) - 1 AS pos, count(*) OVER () AS total FROM tree WHERE total = 1
), upper AS (
  SELECT 0 AS level, pos, total, subroot AS digest FROM subroots
  UNION ALL
  SELECT a.level + 1, a.pos // 2, (a.total + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM upper a LEFT JOIN upper b ON b.pos = a.pos + 1
  WHERE a.pos % 2 = 0 AND a.total > 1
), walk AS (
  SELECT rid, has, l, 0 AS level, pos, total, claim AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.rid, w.has, w.l, w.level + 1, w.pos // 2, (w.total + 1) // 2,
    CASE WHEN s.digest IS NULL THEN sha256(w.folded) WHEN w.pos % 2 = 0 THEN sha256(w.folded || s.digest) ELSE sha256(s.digest || w.folded) END,
    w.proof || coalesce(s.digest, '')
  FROM walk w LEFT JOIN tree s ON s.has = w.has AND s.l = w.l AND s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.total > 1
), climb AS (
  SELECT w.rid, 0 AS level, r.pos, r.total, w.folded, w.proof FROM walk w JOIN subroots r ON r.has = w.has AND r.l = w.l WHERE w.total = 1
  UNION ALL
  SELECT w.rid, w.level + 1, w.pos // 2, (w.total + 1) // 2,
    CASE WHEN s.digest IS NULL THEN sha256(w.folded) WHEN w.pos % 2 = 0 THEN sha256(w.folded || s.digest) ELSE sha256(s.digest || w.folded) END,
    w.proof || coalesce(s.digest, '')
  FROM climb w LEFT JOIN upper s ON s.level = w.level AND s.pos = xor(w.pos, 1)
  WHERE w.total > 1
), root AS (SELECT digest AS root FROM upper WHERE total = 1)
SELECT leaf.doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM leaf JOIN subroots USING (has, l) JOIN climb ON climb.rid = leaf.rid AND climb.total = 1 CROSS JOIN root
"""


@query("op13_merkle_manifest", _MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "lang", "n_chars", "text")
    tampered = F.when(samples.remainder("doc_id", 7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    sealed = lambda n_chars: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text"))
    leaves = documents.select("doc_id", "lang", sealed(F.col("n_chars")).alias("leaf"), sealed(tampered).alias("claim"))
    return merkle.manifest(leaves, claim="claim").select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(merkle.proof_text().cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


_SEARCH_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ts
  FROM documents
), totals AS (
  SELECT count(*) AS n_docs, CAST(sum(len(ts)) AS BIGINT) AS n_terms FROM d WHERE len(ts) > 0
), asked AS (
  SELECT row_number() OVER () AS number, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS ts
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), terms AS (
  SELECT number, unnest(ts) AS t FROM asked
), occurring AS (
  SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM terms) GROUP BY rid, t
), weighted AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM occurring, totals GROUP BY t
), impact AS (
  SELECT rid, t, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * len(ts) * n_docs) // n_terms))) AS part
  FROM occurring JOIN d USING (rid) JOIN weighted USING (t), totals
), scored AS (
  SELECT number, rid, CAST(sum(part) AS BIGINT) AS score FROM terms JOIN impact USING (t) GROUP BY number, rid
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scored JOIN d USING (rid) JOIN asked USING (number) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op12_ranked_search", _SEARCH_SQL)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
