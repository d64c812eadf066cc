"""Queries of this subpackage with their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import bpe, canonical, docpairs, generated, neighbors, packing, ranking, readability
from cartolith.session import cut_lineage, table


def p1_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand for their repository, with the reason."""
    return generated.not_written_by_hand(
        table(spark, folder, "code_embeddings"),
        table(spark, folder, "source_files"),
        table(spark, folder, "upstream_files"),
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Files that were not written by hand for their repository."""
    return p1_files(spark, folder).select("repo_key", "file_path")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Entries whose body is a copy of another entry's, with the first of the group."""
    return canonical.copy_members(table(spark, folder, "symbol_entries"))


def p2_collapsed(spark: SparkSession, folder: str) -> DataFrame:
    """One record per group of copies with the number of its copies."""
    return canonical.collapse_copies(table(spark, folder, "symbol_entries"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The hypothesis in first place of each investigation."""
    scored = ranking.investigation_scores(
        table(spark, folder, "hypotheses"), table(spark, folder, "research_scores")
    )
    return ranking.first_places(scored, "investigation_id", "hyp_id")


def p3_ranking(spark: SparkSession, folder: str) -> DataFrame:
    """Every hypothesis with its closeness to the ideal point and its place in its investigation."""
    scored = ranking.investigation_scores(
        table(spark, folder, "hypotheses"), table(spark, folder, "research_scores")
    )
    return ranking.ranked(scored, "investigation_id", "hyp_id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols with a cosine of 0.90 or more of which one is among the other's five most similar."""
    near = neighbors.nearest_neighbors(table(spark, folder, "code_embeddings"), k=5, least=0.90)
    return near.select(F.least("q", "d").alias("vec_id_a"), F.greatest("q", "d").alias("vec_id_b")).distinct()


def p4_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    """The five most similar symbols of every row whose id is divisible by 100, against all rows."""
    near = neighbors.nearest_neighbors(
        table(spark, folder, "code_embeddings"), k=5, queries=lambda i: i % 100 == 0, probes=neighbors.DEEP_PROBES
    )
    return near.select(F.col("q").alias("vec_id"), F.col("d").alias("near_id"), "place", F.round("cosine", 6).alias("cosine"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Functions and methods with a body and a description that says something."""
    return docpairs.documented_functions(table(spark, folder, "symbol_entries")).select("entry_id")


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Code and description of each documented function or method."""
    return docpairs.documented_functions(table(spark, folder, "symbol_entries"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_documents(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in containers of each capacity."""
    return packing.pack_documents(table(spark, folder, "documents"), table(spark, folder, "pack_sizes"))


def p8_invariants(spark: SparkSession, folder: str) -> DataFrame:
    """Of every pack: documents, and how many are missing, placed twice or split for no reason, and overfull containers."""
    documents, packs = table(spark, folder, "documents"), table(spark, folder, "pack_sizes")
    containers = cut_lineage(packing.pack_documents(documents, packs), "containers")
    reports = [
        packing.container_report(
            containers,
            cut_lineage(bpe.encode_documents(documents, tokenizer=r["tokenizer"], counts_only=True), "token-counts"),
            packs.where(F.col("tokenizer") == r["tokenizer"]),
        )
        for r in packs.select("tokenizer").where("tokenizer IS NOT NULL").distinct().orderBy("tokenizer").collect()
    ]
    return reduce(DataFrame.unionByName, reports).select("pack_name", "items", "missing", "repeated", "split", "overfull")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Band of reading level of every document with enough English prose."""
    levels = readability.reading_levels(table(spark, folder, "documents"))
    return levels.where(F.col("band").isNotNull()).select("doc_id", "band")


def p9_levels(spark: SparkSession, folder: str) -> DataFrame:
    """Words and sentences of English prose, grade, band and school years of every document."""
    return readability.with_school_years(readability.reading_levels(table(spark, folder, "documents")), table(spark, folder, "doc_grades"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_files": p1_files,
    "p2_found": p2_found,
    "p2_collapsed": p2_collapsed,
    "p3_found": p3_found,
    "p3_ranking": p3_ranking,
    "p4_found": p4_found,
    "p4_neighbors": p4_neighbors,
    "p6_found": p6_found,
    "p6_pairs": p6_pairs,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_invariants": p8_invariants,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}

_COPIES = r"""
WITH entries AS (
  SELECT DISTINCT entry_id, body, kind IS NOT DISTINCT FROM 'struct' AS unordered
  FROM symbol_entries WHERE entry_id IS NOT NULL AND body <> ''),
canonical AS (
  SELECT entry_id, unordered,
         CASE WHEN unordered THEN array_to_string(list_sort(list_filter(list_transform(
                regexp_split_to_array(body, '[\n\r,;{}]'),
                lambda m: lower(regexp_replace(m, '[^\p{L}\p{N}]+', '', 'g'))), lambda m: m <> '')), chr(10))
              ELSE lower(regexp_replace(body, '[^\p{L}\p{N}]+', '', 'g')) END AS canon
  FROM entries),
grouped AS (
  SELECT entry_id, min(entry_id) OVER (PARTITION BY canon, unordered) AS first_id FROM canonical WHERE canon <> '')
"""

_RANKED = r"""
WITH latest AS (
  SELECT *, CASE WHEN starts_with(slashed, '/srv/checkouts/' || repo_key || '/')
                 THEN substr(slashed, length('/srv/checkouts/' || repo_key || '/') + 1)
                 ELSE regexp_replace(slashed, '^(?:\./+)+', '') END AS rel_path
  FROM (SELECT *, replace(file, '\', '/') AS slashed,
               row_number() OVER (PARTITION BY investigation_id, hyp_id
                                  ORDER BY reported_at DESC, span_count DESC NULLS LAST, anomaly_score DESC NULLS LAST) AS rn
        FROM hypotheses) WHERE rn = 1),
fused AS (
  SELECT investigation_id, rel_path, max_by(fused_score, scored_at) AS fused_score
  FROM research_scores GROUP BY ALL),
long AS (
  SELECT investigation_id, hyp_id, k, CASE WHEN v >= 0 AND isfinite(v) THEN v END AS v
  FROM (SELECT l.investigation_id, l.hyp_id,
               unnest([1, 2, 3]) AS k,
               unnest([l.span_count::DOUBLE, l.anomaly_score, f.fused_score]) AS v
        FROM latest l LEFT JOIN fused f USING (investigation_id, rel_path))),
bounds AS (
  SELECT investigation_id, k, quantile_disc(v, 0.05) AS lo, quantile_disc(v, 0.95) AS hi, min(v) AS least, max(v) AS most
  FROM long GROUP BY ALL),
drawn AS (
  SELECT investigation_id, hyp_id, k, coalesce(greatest(least(coalesce(v, least), hi), lo) - lo, 0) AS v,
         CASE WHEN most > least THEN (coalesce(v, least) - least) / (most - least) END AS share
  FROM long JOIN bounds USING (investigation_id, k)),
normed AS (
  SELECT *, v / nullif(sqrt(sum(v * v) OVER w), 0) AS u FROM drawn WINDOW w AS (PARTITION BY investigation_id, k)),
ends AS (
  SELECT investigation_id, k, var_pop(u) AS variance, max(u) AS hi, min(u) AS lo FROM normed GROUP BY ALL),
distances AS (
  SELECT investigation_id, hyp_id,
         sqrt(sum(CASE WHEN hi > lo THEN ((hi - u) / variance) ** 2 ELSE 0 END)) AS to_ideal,
         sqrt(sum(CASE WHEN hi > lo THEN ((u - lo) / variance) ** 2 ELSE 0 END)) AS to_anti,
         sqrt(sum(coalesce((1 - share) ** 2, 0))) AS as_is_ideal, sqrt(sum(coalesce(share ** 2, 0))) AS as_is_anti
  FROM normed JOIN ends USING (investigation_id, k) GROUP BY ALL),
scored AS (
  SELECT investigation_id, hyp_id,
         CASE WHEN to_ideal + to_anti > 0 THEN to_anti / (to_ideal + to_anti) ELSE 0.5 END AS closeness,
         CASE WHEN as_is_ideal + as_is_anti > 0 THEN as_is_anti / (as_is_ideal + as_is_anti) ELSE 0.5 END AS as_is
  FROM distances),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY investigation_id ORDER BY round(closeness, 9) DESC, round(as_is, 9) DESC, hyp_id) AS place FROM scored)
"""

_PAIRS = """
WITH latest AS (
  SELECT vec_id, embedding FROM (
    SELECT vec_id, embedding, row_number() OVER (PARTITION BY repo_key, file_path, symbol_name
                                                 ORDER BY updated_at DESC, vec_id DESC) AS rn
    FROM code_embeddings) WHERE rn = 1),
vectors AS (
  SELECT vec_id, embedding::DOUBLE[64] AS v FROM latest
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND list_max(list_transform(embedding, lambda x: abs(x))) > 0),
pairs AS (
  SELECT a.vec_id AS q, b.vec_id AS d, array_cosine_similarity(a.v, b.v) AS cosine
  FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE array_cosine_similarity(a.v, b.v) >= 0.90),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(cosine, 12) DESC, d) AS place FROM pairs)
"""

SQL = {
    "p8_invariants": """
        SELECT pack_name, count(*) AS items, 0::BIGINT AS missing, 0::BIGINT AS repeated, 0::BIGINT AS split, 0::BIGINT AS overfull
        FROM pack_sizes, documents WHERE doc_id IS NOT NULL GROUP BY pack_name""",
    "p4_found": _PAIRS
    + "SELECT DISTINCT least(q, d) AS vec_id_a, greatest(q, d) AS vec_id_b FROM ranked WHERE place <= 5",
    "p2_found": _COPIES + "SELECT first_id, entry_id FROM grouped WHERE entry_id <> first_id",
    "p2_collapsed": _COPIES + "SELECT first_id, count(*) AS copies FROM grouped GROUP BY first_id",
    "p3_found": _RANKED + "SELECT investigation_id, hyp_id FROM placed WHERE place = 1",
    "p3_ranking": _RANKED + "SELECT investigation_id, hyp_id, round(closeness, 9) AS closeness, place FROM placed",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL
