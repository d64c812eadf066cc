"""Queries of retrieval: keyword, trigram, dense and sparse arms, fusion, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import predicates, text
from cartolith.operators import retrieval
from cartolith.session import table
from cartolith.sources.tables import ENTRIES_SQL, FILES_SQL, entries, files

QUESTIONS = {"cursor": "which cursor walks the shard", "budget": "merge budget ledger error", "cache": "stale cache window"}


def questions(spark: SparkSession) -> DataFrame:
    """``query, term``: the keywords of each question, found on the driver."""
    rows = spark.createDataFrame(list(QUESTIONS.items()), "query string, question string")
    return rows.select("query", F.explode(text.keywords(F.col("question"))).alias("term"))


def search_docs(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder)
    return own.select(
        F.col("entry_id").alias("doc"), F.col("name").alias("symbol"), F.col("file").alias("path"), F.col("doc_comment").alias("doc_text")
    )


def r5_bm25f(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.bm25f(search_docs(spark, folder), questions(spark), predicates.is_low_priority(F.col("path")))


def t4_trigram(spark: SparkSession, folder: str) -> DataFrame:
    docs = entries(spark, folder).select(F.col("entry_id").alias("doc"), "name", F.col("file").alias("path"))
    return retrieval.trigram_scores(docs, "walkShardCursor")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


PROBE = [((k * 37) % 64 - 31.5) / 64 for k in range(64)]


def t2_dense(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.dense_neighbours(_vectors(spark, folder), PROBE, k=20)


def t3_sparse(spark: SparkSession, folder: str) -> DataFrame:
    """Sparse vectors of symbols: words of name and comment with the logarithm of their counts."""
    words = search_docs(spark, folder).select(
        "doc", F.explode(text.field_tokens(F.concat_ws(" ", "symbol", "doc_text"))).alias("term")
    )
    vectors = words.groupBy("doc", "term").agg(F.log1p(F.count("*").cast("double")).alias("w"))
    query = questions(spark).select("term").distinct().withColumn("w", F.lit(1.0))
    return retrieval.sparse_scores(vectors, query)


def arms(spark: SparkSession, folder: str) -> DataFrame:
    """Three ranked lists of hypotheses per investigation: by spans, by anomaly, by time."""
    rows = table(spark, folder, "hypotheses").groupBy("investigation_id", "hyp_id").agg(
        F.max("span_count").alias("span_count"), F.max("anomaly_score").alias("anomaly"), F.max("reported_at").alias("at")
    ).na.fill(0, ["span_count"]).na.fill(0.0, ["anomaly"])

    def arm(name: str, column: str) -> DataFrame:
        order = Window.partitionBy("investigation_id").orderBy(F.desc(column), "hyp_id")
        return rows.select(
            F.col("investigation_id").alias("query"), F.lit(name).alias("arm"), F.col("hyp_id").alias("doc"),
            F.row_number().over(order).alias("place"),
        )

    return arm("semantic", "span_count").unionByName(arm("keyword", "anomaly")).unionByName(arm("recency", "at"))


def r8_rank_fusion(spark: SparkSession, folder: str) -> DataFrame:
    """Every row of every arm fused, as the reference does by default."""
    return retrieval.fuse_ranks(arms(spark, folder), window=None)


def r11_score_fusion(spark: SparkSession, folder: str) -> DataFrame:
    signals = files(spark, folder).select(
        F.concat_ws("#", "repo", "path").alias("file"), F.col("size").cast("double").alias("size"), F.col("lines").cast("double").alias("lines")
    )
    return retrieval.fuse_scores(signals, {"size": 0.5, "lines": 0.3})


def r14_stale(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "code_embeddings").dropDuplicates(["vec_id"]).select(
        F.col("repo_key").alias("query"), F.col("vec_id").alias("doc"), "updated_at",
        F.row_number().over(Window.partitionBy("repo_key").orderBy("vec_id")).alias("place"),
    )
    return retrieval.demote_stale(rows, F.lit("2025-02-01").cast("timestamp")).select("query", "doc", "stale", "new_place")


def _metrics(spark: SparkSession, folder: str, fused: DataFrame) -> DataFrame:
    good = table(spark, folder, "hypotheses").where(F.col("confidence") == "high").select(
        F.col("investigation_id").alias("query"), F.col("hyp_id").alias("doc"), F.lit(1).alias("relevant")
    ).distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    judged = fused.withColumn("place", F.row_number().over(order)).join(good, ["query", "doc"], "left").na.fill(0, ["relevant"])
    total = good.groupBy("query").agg(F.count("*").alias("n"))
    return retrieval.ranking_metrics(judged, total)


def r17_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Fused lists judged by high confidence."""
    return _metrics(spark, folder, r8_rank_fusion(spark, folder))


def _means(spark: SparkSession, folder: str, metrics: DataFrame) -> DataFrame:
    repos = table(spark, folder, "hypotheses").select(F.col("investigation_id").alias("query"), "repo_key").distinct()
    means = retrieval.mean_metrics(metrics.join(repos, "query"), ["repo_key"])
    return means.withColumn("repo_key", F.coalesce("repo_key", F.lit("*")))


def a25_mean_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return _means(spark, folder, r17_metrics(spark, folder))


def a26_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.percentiles(table(spark, folder, "events"), "event_type", "value")


def r17_label_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Complex entries of each repository against labels in three forms: a symbol, a whole path with it, the end of a path with it."""
    own = entries(spark, folder).where("repo_key IS NOT NULL AND name IS NOT NULL AND file IS NOT NULL")
    order = Window.partitionBy("repo_key").orderBy(F.desc_nulls_last("complexity"), "entry_id")
    hits = own.select(F.col("repo_key").alias("query"), "file", F.col("name").alias("symbol"), F.row_number().over(order).alias("place"))
    form = F.col("entry_id") % 3
    label = F.when(form == 0, F.col("name")).when(form == 1, F.concat_ws(":", "file", "name")).otherwise(F.concat_ws(":", F.substring_index("file", "/", -1), "name"))
    return retrieval.label_recall(hits, own.where("kind = 'method'").select(F.col("repo_key").alias("query"), label.alias("label")), 20)


QUERIES = {
    "r17_label_recall": r17_label_recall,
    "r5_bm25f": r5_bm25f,
    "t4_trigram": t4_trigram,
    "t2_dense": t2_dense,
    "t3_sparse": t3_sparse,
    "r8_rank_fusion": r8_rank_fusion,
    "r11_score_fusion": r11_score_fusion,
    "r14_stale": r14_stale,
    "r17_metrics": r17_metrics,
    "a25_mean_metrics": a25_mean_metrics,
    "a26_percentiles": a26_percentiles,
}

_SPLIT = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace({w}, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'),"
    r" '([A-Za-z])([0-9])', '\1 \2', 'g'), '([0-9])([A-Za-z])', '\1 \2', 'g')"
)


def _tokens(column: str, compact: bool = False) -> str:
    """All tokens of a text field as a list: words and their parts of at least three characters, run together if ``compact``."""
    words = f"regexp_extract_all(coalesce({column}, ''), '[A-Za-z0-9]+')"
    parts = f"list_filter(list_transform(regexp_split_to_array({_SPLIT.format(w='w')}, '[^A-Za-z0-9]+'), lambda p: lower(p)), lambda p: length(p) >= 2 AND p <> lower(w))"
    more = f", CASE WHEN len({words}) > 1 THEN [lower(array_to_string({words}, ''))] ELSE [] END" if compact else ""
    return f"list_filter(list_concat(list_transform({words}, lambda w: lower(w)), flatten(list_transform({words}, lambda w: {parts})){more}), lambda t: length(t) >= 3)"


_TERMS = "terms(query, term) AS (VALUES " + ", ".join(
    f"('{q}', '{t}')"
    for q, s in QUESTIONS.items()
    for t in dict.fromkeys(w for w in s.split() if len(w) >= 3 and w not in text.STOP_WORDS)
) + ")"


def _grams(column: str) -> str:
    words = f"regexp_extract_all(lower({column}), '[a-z0-9]+')"
    return f"list_distinct(flatten(list_transform({words}, lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"


def _jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0 END"


_ARMS = """
WITH rows AS (SELECT investigation_id AS query, hyp_id AS doc, coalesce(max(span_count), 0) AS s, CASE WHEN isnan(max(anomaly_score)) THEN 0 ELSE coalesce(max(anomaly_score), 0) END AS a, max(reported_at) AS t FROM hypotheses GROUP BY ALL),
arms AS (SELECT query, 'semantic' AS arm, 1.0 AS w, doc, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc) AS place FROM rows
  UNION ALL SELECT query, 'keyword', 0.5, doc, row_number() OVER (PARTITION BY query ORDER BY a DESC, doc) FROM rows
  UNION ALL SELECT query, 'recency', 0.1, doc, row_number() OVER (PARTITION BY query ORDER BY t DESC, doc) FROM rows),
fused AS (SELECT query, doc, round(sum(w / (60 + place)), 9) AS score, CASE WHEN count(DISTINCT arm) > 1 THEN 'hybrid' ELSE min(arm) END AS source FROM arms GROUP BY ALL)
"""
_JUDGED = _ARMS + """, good AS (SELECT DISTINCT investigation_id AS query, hyp_id AS doc FROM hypotheses WHERE confidence = 'high'),
total AS (SELECT query, count(*) AS n FROM good GROUP BY query),
judged AS (SELECT f.query, row_number() OVER (PARTITION BY f.query ORDER BY score DESC, f.doc) AS place, (g.doc IS NOT NULL)::INT AS rel FROM fused f LEFT JOIN good g USING (query, doc)),
rolled AS (SELECT query, sum(CASE WHEN rel = 1 AND place <= 10 THEN 1 / log2(place + 1) ELSE 0 END) AS dcg, count(*) FILTER (rel = 1 AND place <= 10) AS a10,
  count(*) FILTER (rel = 1 AND place <= 20) AS a20, min(place) FILTER (rel = 1) AS first FROM judged GROUP BY query),
metrics AS (SELECT query, round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda i: 1 / log2(i + 1))), 6) AS ndcg10, round(a10 / n, 6) AS recall10, round(a20 / n, 6) AS recall20,
  round(coalesce(1 / first, 0), 6) AS mrr FROM rolled JOIN total USING (query))
"""
_LOW = f"{predicates.LOW_PRIORITY}|{predicates.TEST_FILE}"
SQL = {
    "r17_label_recall": "WITH " + ENTRIES_SQL + """, own AS (SELECT * FROM entries WHERE repo_key IS NOT NULL AND name IS NOT NULL AND file IS NOT NULL),
      hits AS (SELECT repo_key AS query, file, name, row_number() OVER (PARTITION BY repo_key ORDER BY complexity DESC NULLS LAST, entry_id) AS place FROM own),
      labels AS (SELECT DISTINCT repo_key AS query, CASE entry_id % 3 WHEN 0 THEN name WHEN 1 THEN file || ':' || name ELSE regexp_extract(file, '([^/]*)$', 1) || ':' || name END AS label FROM own WHERE kind = 'method')
      SELECT l.query, round(count(*) FILTER (EXISTS (SELECT 1 FROM hits h WHERE h.query = l.query AND place <= 20 AND (h.name = label OR h.file || ':' || h.name = label
        OR (contains(label, ':') AND h.name = split_part(label, ':', 2) AND ends_with(h.file, split_part(label, ':', 1)))))) / count(*), 6) AS recall FROM labels l GROUP BY l.query""",
    "r5_bm25f": f"""WITH {ENTRIES_SQL}, {_TERMS},
      tok AS MATERIALIZED (SELECT entry_id AS doc, {_tokens('name', True)} AS s, {_tokens('file', True)} AS p, {_tokens('doc_comment')} AS d, coalesce(regexp_matches(file, '{_LOW}'), false) AS low, CASE WHEN length(doc_comment) > 0 THEN 2.0 ELSE 0 END AS docs FROM entries),
      len AS (SELECT doc, low, 5.0 * len(s) + docs + 5.0 AS length FROM tok),
      corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
      tf AS (SELECT doc, term, sum(w) AS tf FROM (SELECT doc, unnest(s) AS term, 5.0 AS w FROM tok UNION ALL SELECT doc, unnest(p), 5.0 FROM tok UNION ALL SELECT doc, unnest(d), 2.0 FROM tok)
             WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
      SELECT t.query, tf.doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf / CASE WHEN low THEN 5 ELSE 1 END) * 2.2 / (tf / CASE WHEN low THEN 5 ELSE 1 END + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM tf JOIN df USING (term) JOIN len USING (doc) JOIN terms t USING (term), corpus GROUP BY ALL""",
    "t4_trigram": f"""WITH {ENTRIES_SQL}, g AS MATERIALIZED (SELECT entry_id AS doc, {_grams('name')} AS a, {_grams('file')} AS b, {_grams("'walkShardCursor'")} AS q FROM entries),
      s AS (SELECT doc, {_jaccard('a', 'q')} AS ns, {_jaccard('b', 'q')} AS ps FROM g)
      SELECT doc, round((2 * ns + ps) / 3, 6) AS score, round(greatest(0.25, 0.75 - 0.5 * (2 * ns + ps) / 3), 6) AS distance FROM s WHERE ns > 0.1 OR ps > 0.1""",
    "t2_dense": f"SELECT vec_id AS id, round(1 - list_cosine_similarity(embedding::DOUBLE[], {PROBE}::DOUBLE[]), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 20",
    "t3_sparse": f"""WITH {ENTRIES_SQL}, {_TERMS}, tok AS (SELECT entry_id AS doc, unnest({_tokens("concat_ws(' ', name, doc_comment)")}) AS term FROM entries),
      v AS (SELECT doc, term, ln(1 + count(*)) AS w FROM tok GROUP BY ALL)
      SELECT doc, round(sum(w), 6) AS score FROM v WHERE term IN (SELECT term FROM terms) GROUP BY doc""",
    "r8_rank_fusion": _ARMS + "SELECT * FROM fused",
    "r11_score_fusion": f"""WITH {FILES_SQL}, r AS (SELECT min(size) AS ls, max(size) AS hs, min(lines) AS ll, max(lines) AS hl FROM files)
      SELECT repo || '#' || path AS file, round(0.5 * coalesce((size - ls) / (hs - ls), 0) + 0.3 * coalesce((lines - ll) / (hl - ll), 0), 6) AS score FROM files, r""",
    "r14_stale": """WITH rows AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY doc) AS place FROM (SELECT DISTINCT ON (vec_id) repo_key AS query, vec_id AS doc, updated_at FROM code_embeddings)),
      s AS (SELECT *, coalesce(updated_at < TIMESTAMP '2025-02-01' - INTERVAL 1 MINUTE, false) AS stale FROM rows)
      SELECT query, doc, stale, row_number() OVER (PARTITION BY query ORDER BY stale, place)::INT AS new_place FROM s""",
    "r17_metrics": _JUDGED + "SELECT * FROM metrics",
    "a25_mean_metrics": _JUDGED + """, m AS (SELECT metrics.*, repo_key FROM metrics JOIN (SELECT DISTINCT investigation_id AS query, repo_key FROM hypotheses) USING (query))
      SELECT coalesce(repo_key, '*') AS repo_key, count(*) AS queries, round(avg(ndcg10), 6) AS ndcg10, round(avg(recall10), 6) AS recall10, round(avg(recall20), 6) AS recall20, round(avg(mrr), 6) AS mrr
      FROM m GROUP BY GROUPING SETS ((repo_key), ())""",
    "a26_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type",
}
