"""The registered queries of the operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, fill_in_middle, importance_resampling, language_id, line_dedup, lm_scoring, minhash_dedup, packing, quality, simhash_dedup, token_counts, topk_search, toxicity
from docloom.llm._sample import id_remainder
from docloom.session import read_table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"))


def op1_lm_scoring_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator with the shorter context."""
    return lm_scoring.score_documents(read_table(spark, sf_dir, "documents"), order=2)


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.integer_vectors(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk_search.top_k(vectors, vectors.where("id % 50 = 0"), k=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return decontaminate.contamination_report(found)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), capacity=4096)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    held_out = id_remainder("doc_id", 5) == 0
    model = quality.train(docs, labels.where(~held_out))
    return quality.score_documents(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), threshold=0.8)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(line_dedup.dedup_lines(read_table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = language_id.train(docs.where(~held_out))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), limit=1024)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance_resampling.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), buckets=10_000)
    return importance_resampling.resample(scored, min_words=20, percent=10).select("doc_id", "n_features", "weight", "score", "rank")


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), radius=2)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle.transform(read_table(spark, sf_dir, "documents"), seed="1:")
    digest = {"output_sha256": F.sha2(F.col("output").cast("binary"), 256), "restored_sha256": F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256)}
    return cut.withColumns(digest).drop("output")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_lm_scoring, op1_lm_scoring_bigrams, op2_topk_search, op3_decontamination, op4_toxicity, op5_packing, op6_quality, op7_minhash_dedup, op8_line_dedup, op9_language_id, op10_token_counts, op11_importance_resampling, op12_simhash_dedup, op13_fill_in_middle)
}

_DOC_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_lm_scoring_bigrams": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_DOC_WORDS} AS words FROM documents),
w AS (SELECT r, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
uni AS (SELECT w, count(*) AS c FROM w GROUP BY w), own1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w),
bi AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY v, w), own2 AS (SELECT r, v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY r, v, w),
size AS (SELECT count(*) AS n FROM w),
s AS (SELECT w.r, uni.c - own1.c AS c1, p.c - q.c AS c0, bi.c - own2.c AS c2, w.v, greatest(size.n - len(d.words), 1) AS n
      FROM w JOIN d ON d.r = w.r JOIN uni ON uni.w = w.w JOIN own1 ON own1.r = w.r AND own1.w = w.w LEFT JOIN bi ON bi.v = w.v AND bi.w = w.w
      LEFT JOIN own2 ON own2.r = w.r AND own2.v = w.v AND own2.w = w.w LEFT JOIN uni p ON p.w = w.v LEFT JOIN own1 q ON q.r = w.r AND q.w = w.v, size),
t AS (SELECT r, sum(CASE WHEN c2 > 0 THEN ln(c2 / c0) WHEN v IS NULL THEN ln(greatest(c1, 1) / n) ELSE ln(greatest(c1, 1) / n) + ln(0.4) END) AS s FROM s GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(words), 6) AS mean_log_score FROM d LEFT JOIN t ON t.r = d.r""",
    "op1_lm_scoring": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_DOC_WORDS} AS words FROM documents),
w AS (SELECT r, i, words[i] AS w, CASE WHEN i > 1 THEN words[i - 1] END AS v, CASE WHEN i > 2 THEN words[i - 2] END AS u FROM (SELECT r, words, unnest(range(1, len(words) + 1)) AS i FROM d)),
uni AS (SELECT w, count(*) AS c FROM w GROUP BY w), own1 AS (SELECT r, w, count(*) AS c FROM w GROUP BY r, w),
bi AS (SELECT v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY v, w), own2 AS (SELECT r, v, w, count(*) AS c FROM w WHERE v IS NOT NULL GROUP BY r, v, w),
tri AS (SELECT u, v, w, count(*) AS c FROM w WHERE u IS NOT NULL GROUP BY u, v, w), own3 AS (SELECT r, u, v, w, count(*) AS c FROM w WHERE u IS NOT NULL GROUP BY r, u, v, w),
size AS (SELECT count(*) AS n FROM w),
s AS (SELECT w.r, uni.c - own1.c AS c1, p.c - q.c AS c0, bi.c - own2.c AS c2, b.c - o.c AS c20, tri.c - own3.c AS c3, w.u, w.v, greatest(size.n - len(d.words), 1) AS n
      FROM w JOIN d ON d.r = w.r JOIN uni ON uni.w = w.w JOIN own1 ON own1.r = w.r AND own1.w = w.w LEFT JOIN bi ON bi.v = w.v AND bi.w = w.w
      LEFT JOIN own2 ON own2.r = w.r AND own2.v = w.v AND own2.w = w.w LEFT JOIN uni p ON p.w = w.v LEFT JOIN own1 q ON q.r = w.r AND q.w = w.v
      LEFT JOIN tri ON tri.u = w.u AND tri.v = w.v AND tri.w = w.w LEFT JOIN own3 ON own3.r = w.r AND own3.u = w.u AND own3.v = w.v AND own3.w = w.w
      LEFT JOIN bi b ON b.v = w.u AND b.w = w.v LEFT JOIN own2 o ON o.r = w.r AND o.v = w.u AND o.w = w.v, size),
t AS (SELECT r, sum(CASE WHEN c3 > 0 THEN ln(c3 / c20) ELSE CASE WHEN u IS NULL THEN 0 ELSE ln(0.4) END
      + CASE WHEN c2 > 0 THEN ln(c2 / c0) WHEN v IS NULL THEN ln(greatest(c1, 1) / n) ELSE ln(greatest(c1, 1) / n) + ln(0.4) END END) AS s FROM s GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, round(coalesce(s, 0), 4) AS log_score, round(s / len(words), 6) AS mean_log_score FROM d LEFT JOIN t ON t.r = d.r""",
    "op2_topk_search": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_decontamination": rf"""
WITH d AS (SELECT doc_id, {_DOC_WORDS} AS words FROM documents), b AS (SELECT item_id, {_DOC_WORDS} AS words FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(words[k : k + n - 1], ' ') AS g
        FROM (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS k FROM b WHERE len(words) > 0)),
gram AS (SELECT doc_id, k, n, array_to_string(words[k : k + n - 1], ' ') AS g
         FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM win) WHERE len(words) >= n)),
hit AS (SELECT doc_id, item_id, k, gram.n FROM gram JOIN win ON gram.g = win.g AND gram.n = win.n),
h AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS i FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",
    "op11_importance_resampling": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_DOC_WORDS} AS words FROM documents), b AS (SELECT {_DOC_WORDS} AS words FROM benchmark),
dw AS (SELECT r, unnest(words) AS w FROM d), bw AS (SELECT unnest(words) AS w FROM b),
crc AS (SELECT list_transform(range(256), lambda i: list_reduce([0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
f AS (SELECT w, xor(list_reduce(list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS k FROM v, crc),
s AS (SELECT k, count(*) AS s FROM dw JOIN f USING (w) GROUP BY k), t AS (SELECT k, count(*) AS t FROM bw JOIN f USING (w) GROUP BY k),
n AS (SELECT (SELECT count(*) FROM dw) AS s, (SELECT count(*) FROM bw) AS t),
g AS (SELECT s.k, CAST(floor(1000 * ln(CAST(coalesce(t.t, 0) + 1 AS DOUBLE) * (n.s + 10000) / (CAST(s.s + 1 AS DOUBLE) * (n.t + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t ON t.k = s.k, n),
w AS (SELECT r, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN f USING (w) JOIN g USING (k) GROUP BY r),
x AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON w.r = d.r),
y AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM y)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM z""",
    "op13_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 90 THEN 'plain' WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1 : a], '') AS p, array_to_string(u[a + 1 : b], '') AS m, array_to_string(u[b + 1 : n], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256 FROM p""",
}
