"""Queries of hybrid search, research and duplicate triage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.functions import predicates, text
from cartolith.functions.text import cosine
from cartolith.operators import duplicates, quality, retrieval, search, vectors
from cartolith.plans.graph_queries import _PR, W, ranked_graph
from cartolith.plans.quality_queries import _CALLS, call_sites
from cartolith.plans.retrieval_queries import _LOW, PROBE, _grams, _jaccard, _tokens
from cartolith.session import cut_lineage, table
from cartolith.sources.tables import ENTRIES_SQL, FILES_SQL, entries, files, snapshot_graphs

QUESTION = "where does the merge of a shard budget walk the ledgerCursor"
KEYWORDS = ["merge", "shard", "budget", "walk", "ledger", "cursor"]
TERMS = text.query_terms(QUESTION)


def current_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """``id, repo, file, name, kind, body_hash, vec`` of the latest row of each symbol; vec is null if it is not usable."""
    rows = table(spark, folder, "code_embeddings").where("vec_id IS NOT NULL")
    latest = rows.groupBy("repo_key", "file_path", "symbol_name").agg(
        F.max_by(F.struct("vec_id", "symbol_kind", "body_hash", "embedding"), F.struct("updated_at", "vec_id")).alias("v")
    )
    return latest.select(
        F.col("v.vec_id").alias("id"), F.coalesce("repo_key", F.lit("")).alias("repo"), F.col("file_path").alias("file"), F.col("symbol_name").alias("name"),
        F.col("v.symbol_kind").alias("kind"), F.col("v.body_hash").alias("body_hash"), F.when(vectors.usable(F.col("v.embedding")), F.col("v.embedding")).alias("vec"),
    )


def j14_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of symbols of one repository with a cosine of 0.85 or more."""
    own = current_vectors(spark, folder).where("vec IS NOT NULL")
    return vectors.pairs_within(own, 0.85).withColumn("similarity", F.round("similarity", 6))


def j16_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of which one is among the other's five nearest of its repository at 0.80 or more."""
    own = current_vectors(spark, folder).where("vec IS NOT NULL")
    return vectors.nearest_within(own, 5, 0.80).withColumn("similarity", F.round("similarity", 6))


def _functions(spark: SparkSession, folder: str) -> DataFrame:
    own = current_vectors(spark, folder).where(F.col("kind").isin("function", "method"))
    src = files(spark, folder).select("repo", F.col("path").alias("file"), "content")
    tags = duplicates.build_constraint(F.col("file"), F.col("content"))
    return own.join(src.select("repo", "file", tags.alias("tags")).where("tags IS NOT NULL").dropDuplicates(["repo", "file"]), ["repo", "file"], "left")


def _judged(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Functions, their near pairs, and calls and siblings among these."""
    functions = cut_lineage(_functions(spark, folder), "triage-functions")
    pairs = cut_lineage(duplicates.candidate_pairs(functions.where("vec IS NOT NULL").select("repo", "id", "vec")), "triage-pairs")
    about = entries(spark, folder).groupBy(F.coalesce("repo_key", F.lit("")).alias("repo"), "file", "name").agg(F.max("receiver").alias("receiver"), F.max("body").alias("body"))
    known = cut_lineage(functions.select("id", "repo", "file", "name", "kind").join(about, ["repo", "file", "name"]), "triage-entries")
    called = F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\("), F.lit(1))))
    calls = known.select("repo", F.col("id").alias("src"), called.alias("name")).join(functions.select("repo", "name", F.col("id").alias("dst")), ["repo", "name"]).select("src", "dst")
    ends = [known.select(F.col("id").alias(s), F.col("name").alias(f"n{s}"), F.col("kind").alias(f"k{s}"), F.col("receiver").alias(f"r{s}")) for s in "ab"]
    met = pairs.select("a", "b").join(ends[0], "a").join(ends[1], "b")
    kin = met.where((F.col("na") == F.col("nb")) & (F.col("ka") == "method") & (F.col("kb") == "method") & (F.col("ra") != F.col("rb"))).select("a", "b")
    return functions, pairs, calls, kin


def r20_drop_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many near pairs of functions each filter drops."""
    functions, pairs, calls, kin = _judged(spark, folder)
    return duplicates.drop_counts(duplicates.judged_pairs(pairs, functions, calls, kin))


def r20_triage(spark: SparkSession, folder: str) -> DataFrame:
    functions, _, calls, kin = _judged(spark, folder)
    return duplicates.triage(functions, calls, kin)


def u6_near_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Connected groups of near pairs with their mean similarity and tier."""
    own = current_vectors(spark, folder).where("vec IS NOT NULL")
    return duplicates.near_groups(vectors.nearest_within(own, 5, 0.80))


def r21_duplicate_ratio(spark: SparkSession, folder: str) -> DataFrame:
    own = cut_lineage(current_vectors(spark, folder).where(F.col("kind").isin("function", "method")), "ratio-functions")
    return duplicates.duplicate_ratio(vectors.nearest_within(own.where("vec IS NOT NULL"), 5, 0.80), own)


def j22_common_interface(spark: SparkSession, folder: str) -> DataFrame:
    up = snapshot_graphs(spark, folder).edges.where(F.col("label") == "IMPLEMENTS")
    return duplicates.common_interface_pairs(up)


def j23_connected_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of types with an interface in common between which there is a call."""
    g = snapshot_graphs(spark, folder, stage=True)
    key = lambda *c: F.concat_ws("\0", *c)
    pairs = duplicates.common_interface_pairs(g.edges.where(F.col("label") == "IMPLEMENTS")).select(
        "*", key("graph", "a", "a_file").alias("ka"), key("graph", "b", "b_file").alias("kb")
    )
    calls = g.edges.where(F.col("label") != "IMPLEMENTS").select(key("graph", "src", "src_file").alias("src"), key("graph", "dst", "dst_file").alias("dst"))
    found = duplicates.connected_pairs(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b")), calls)
    return pairs.join(found.select(F.col("a").alias("ka"), F.col("b").alias("kb")), ["ka", "kb"], "left_semi").select("graph", "a", "a_file", "b", "b_file")


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).where("name IS NOT NULL AND file IS NOT NULL").select(F.col("entry_id").alias("doc"), "name", F.col("file").alias("path"))


def r6_candidate_bm25(spark: SparkSession, folder: str) -> DataFrame:
    return search.candidate_bm25(_docs(spark, folder), TERMS, 20)


def _all_symbols(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Symbols of all graphs with their greatest rank and community, and all calls."""
    g = snapshot_graphs(spark, folder, stage=True)
    ranked = ranked_graph(g).join(g.symbols, ["graph", "name", "file"])
    rolled = ranked.groupBy("name", "file").agg(
        F.max(F.round("pagerank", 6)).alias("pagerank"), F.max("community").alias("community"), F.max("complexity").alias("complexity")
    )
    return cut_lineage(rolled, "all-symbols"), g.calls().select("src", "src_file", "dst", "dst_file").distinct()


def g15_graph_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """What the graph adds to the five most complex symbols as seeds."""
    symbols, calls = _all_symbols(spark, folder)
    seeds = symbols.orderBy(F.desc("complexity"), "name", "file").limit(5)
    seeds = seeds.withColumn("place", F.row_number().over(Window.orderBy(F.desc("complexity"), "name", "file")))  # five rows
    return search.graph_candidates(symbols, calls, KEYWORDS, seeds.select("name", "file", "place"))


def _lists(spark: SparkSession, folder: str) -> list[DataFrame]:
    own = entries(spark, folder).where("complexity IS NOT NULL AND name IS NOT NULL AND file IS NOT NULL")
    found = []
    for column in ("complexity", "start_line"):
        order = [F.desc_nulls_last(column), "file", "name", "entry_id"]
        rows = own.orderBy(*order).limit(50).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # fifty rows
        found.append(rows.select("file", "name", "entry_id", "place"))
    return found


def u1_first_of_each(spark: SparkSession, folder: str) -> DataFrame:
    return search.first_of_each(_lists(spark, folder), ["file", "name"])


def u2_nearest_of_each(spark: SparkSession, folder: str) -> DataFrame:
    """Of each file the symbol nearest to a vector."""
    own = current_vectors(spark, folder).where("vec IS NOT NULL")
    wanted = F.array(*[F.lit(float(x)) for x in PROBE])
    rows = own.select("repo", "file", F.round(1 - cosine(F.col("vec"), wanted), 6).alias("distance"), "id")
    return search.nearest_of_each(rows, ["repo", "file"])


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder).where("repo_key IS NOT NULL")
    order = Window.partitionBy("repo_key").orderBy("entry_id")
    return own.select(
        F.col("repo_key").alias("query"), F.col("entry_id").alias("doc"), F.concat_ws("#", "repo_key", F.regexp_replace("file", r"\\", "/")).alias("file"),
        F.row_number().over(order).alias("place"),
    )


def r10_recency(spark: SparkSession, folder: str) -> DataFrame:
    times = files(spark, folder).groupBy(F.concat_ws("#", "repo", "path").alias("file")).agg(F.max(F.unix_timestamp("mod_time")).alias("v"))
    return search.signal_arm(_candidates(spark, folder), times, "v", "recency", 20)


def r10_hotspot(spark: SparkSession, folder: str) -> DataFrame:
    own = quality.file_complexity(entries(spark, folder))
    rolled = own.groupBy(F.concat_ws("#", "repo_key", F.regexp_replace("file", r"\\", "/")).alias("file")).agg(F.max("complexity").alias("v"))
    return search.signal_arm(_candidates(spark, folder), rolled, "v", "hotspot", 20)


def _names(spark: SparkSession, folder: str) -> DataFrame:
    return entries(spark, folder).where("name IS NOT NULL AND file IS NOT NULL").select(F.concat_ws("#", "repo_key", "file").alias("file"), "name")


def r12_seed_weights(spark: SparkSession, folder: str) -> DataFrame:
    return search.seed_weights(_names(spark, folder), TERMS)


def r13_boost(spark: SparkSession, folder: str) -> DataFrame:
    """Seed weights of files raised for each name that begins with a keyword."""
    scores = r12_seed_weights(spark, folder).select("file", F.col("seed").alias("score"))
    begins = F.exists(F.array(*map(F.lit, KEYWORDS)), lambda w: F.startswith(F.lower("name"), w))
    return search.boost_by_names(scores, _names(spark, folder).where(begins))


def _file_links(spark: SparkSession, folder: str) -> DataFrame:
    symbols = entries(spark, folder).select(F.col("repo_key").alias("repo"), "name", "file")
    graph = quality.reference_graph(call_sites(spark, folder), symbols)
    return graph.select(F.concat_ws("#", "repo", "src").alias("src"), F.concat_ws("#", "repo", "dst").alias("dst"), "weight")


def _file_docs(spark: SparkSession, folder: str) -> DataFrame:
    own = entries(spark, folder).where("file IS NOT NULL")
    return own.groupBy(F.concat_ws("#", "repo_key", "file").alias("file")).agg(F.concat_ws("\n", F.array_sort(F.collect_list("doc_comment"))).alias("doc_text"))


def r11_file_rank(spark: SparkSession, folder: str) -> DataFrame:
    return search.file_rank(_file_docs(spark, folder), _names(spark, folder), _file_links(spark, folder), TERMS)


def r11_file_rank_rrf(spark: SparkSession, folder: str) -> DataFrame:
    return search.file_rank(_file_docs(spark, folder), _names(spark, folder), _file_links(spark, folder), TERMS, rrf=True)


def r16_research(spark: SparkSession, folder: str) -> DataFrame:
    """Files that answer the question, within 8,000 tokens."""
    names, links = cut_lineage(_names(spark, folder), "research-names"), cut_lineage(_file_links(spark, folder), "research-links")
    ranked = search.file_rank(_file_docs(spark, folder), names, links, TERMS)
    own = current_vectors(spark, folder).where("vec IS NOT NULL").withColumn("file", F.concat_ws("#", "repo", "file"))
    wanted = F.array(*[F.lit(float(x)) for x in PROBE])
    dense = own.select("file", cosine(F.col("vec"), wanted).alias("score")).orderBy(F.desc("score"), "file").limit(50)
    grams = retrieval.trigram_scores(_docs(spark, folder), " ".join(KEYWORDS)).orderBy("distance", "doc").limit(20)
    where = entries(spark, folder).select(F.col("entry_id").alias("doc"), F.concat_ws("#", "repo_key", "file").alias("file"))
    near = grams.join(where, "doc").select("file", (1 - F.col("distance")).alias("score"))
    symbols, _ = _all_symbols(spark, folder)
    top = symbols.orderBy(F.desc("pagerank"), "name", "file").limit(20).select("file", "pagerank")
    return search.research(ranked, [dense, near], top, links, names, KEYWORDS)


def g16_expand(spark: SparkSession, folder: str) -> DataFrame:
    """Files within two references of those with a name that is a keyword's."""
    seeds = r12_seed_weights(spark, folder).where("seed >= 3").select("file")
    return search.expand_files(seeds, cut_lineage(_file_links(spark, folder), "file-links"), 2)


def x1_sibling_tests(spark: SparkSession, folder: str) -> DataFrame:
    own = files(spark, folder).where("path IS NOT NULL").select(F.concat_ws("/", "repo", "path").alias("file")).distinct()
    return search.sibling_tests(own.where(~predicates.is_test_file(F.col("file"))).select("file", F.lit(1.0).alias("score")), own)


def x2_file_calls(spark: SparkSession, folder: str) -> DataFrame:
    return search.file_calls(snapshot_graphs(spark, folder).calls())


def t6_symbol_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.symbol_search(entries(spark, folder).select("entry_id", "file", "name", "kind"), "merge", None)


def t7_flagged_first(spark: SparkSession, folder: str) -> DataFrame:
    """Entries of each repository, the complex ones first, else in order."""
    rows = _candidates(spark, folder).join(entries(spark, folder).select(F.col("entry_id").alias("doc"), "complexity"), "doc")
    return search.flagged_first(rows, F.col("complexity") >= 10, ["query"]).select("query", "doc", "new_place")


def t8_page(spark: SparkSession, folder: str) -> DataFrame:
    return search.page(entries(spark, folder).select("entry_id", "name", "complexity"), [F.desc_nulls_last("complexity"), "entry_id"], 40, 20)


def t9_choice(spark: SparkSession, folder: str) -> DataFrame:
    """Of each repository the functions chosen within 4,000 lines by complexity and unlikeness of their names' parts."""
    own = entries(spark, folder).where("repo_key IS NOT NULL AND complexity IS NOT NULL AND end_line >= start_line")
    rows = own.select(
        F.col("repo_key").alias("query"), F.col("entry_id").alias("id"), (F.col("complexity") / 50).alias("relevance"),
        (F.col("end_line") - F.col("start_line") + 1).cast("int").alias("size"), text.split_identifier(F.col("name")).alias("tokens"),
    )
    return search.choose_within_budget(rows, 4000)


def w7_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_share_threshold(entries(spark, folder), "complexity", "repo_key")


QUERIES = {
    f.__name__: f
    for f in (
        j14_pairs, j16_nearest, r20_drop_counts, r20_triage, u6_near_groups, r21_duplicate_ratio, j22_common_interface, j23_connected_pairs,
        r6_candidate_bm25, g15_graph_candidates, u1_first_of_each, u2_nearest_of_each, r10_recency, r10_hotspot, r12_seed_weights, r13_boost,
        r11_file_rank, r11_file_rank_rrf, r16_research, g16_expand, x1_sibling_tests, x2_file_calls, t6_symbol_search, t7_flagged_first, t8_page,
        t9_choice, w7_threshold,
    )
}

_E = "WITH " + ENTRIES_SQL
_VECTORS = """vectors AS MATERIALIZED (SELECT id, repo, file, name, kind, body_hash, CASE WHEN usable THEN embedding::DOUBLE[] END AS v FROM (
  SELECT vec_id AS id, coalesce(repo_key, '') AS repo, file_path AS file, symbol_name AS name, symbol_kind AS kind, body_hash, embedding,
    coalesce(len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0, false) AS usable,
    row_number() OVER (PARTITION BY repo_key, file_path, symbol_name ORDER BY updated_at DESC NULLS LAST, vec_id DESC) AS rn FROM code_embeddings WHERE vec_id IS NOT NULL) WHERE rn = 1)"""
_PAIRS = """pairs AS MATERIALIZED (SELECT a.repo, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS similarity FROM {0} a JOIN {0} b ON a.repo = b.repo AND a.id < b.id
  WHERE a.v IS NOT NULL AND b.v IS NOT NULL AND list_cosine_similarity(a.v, b.v) >= {1})"""
_NEAREST = """near AS MATERIALIZED (SELECT DISTINCT repo, least(id, o) AS a, greatest(id, o) AS b, similarity FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, id ORDER BY round(similarity, 9) DESC, o) AS place FROM (SELECT repo, a AS id, b AS o, similarity FROM pairs UNION ALL SELECT repo, b, a, similarity FROM pairs)) WHERE place <= 5)"""
_NEAR = f"WITH {_VECTORS}, {_PAIRS.format('vectors', 0.80)}, {_NEAREST}"
_CALLABLE = "callable AS MATERIALIZED (SELECT * FROM vectors WHERE kind IN ('function', 'method'))"
_TEST = predicates.TEST_FILE.replace("'", "''")
_WORDS = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_KEYS = "[" + ", ".join(f"'{t}'" for t in KEYWORDS) + "]"
_NAMES = "names AS (SELECT concat_ws('#', repo_key, file) AS file, lower(name) AS name FROM entries WHERE name IS NOT NULL AND file IS NOT NULL)"
_SEEDS = f"""seeds AS (SELECT file, sum(CASE WHEN list_contains({_WORDS}, name) THEN 10.0 ELSE len(list_filter({_WORDS}, lambda w: contains(name, w))) END) AS seed,
  sum(list_contains({_WORDS}, name)::INT::DOUBLE) AS exact FROM names GROUP BY file HAVING seed > 0)"""
_IMPLEMENT = """up AS (SELECT DISTINCT graph, src, src_file, dst, dst_file FROM edges WHERE label = 'IMPLEMENTS'),
  kin AS (SELECT DISTINCT x.graph, x.src AS a, x.src_file AS a_file, y.src AS b, y.src_file AS b_file FROM up x JOIN up y USING (graph, dst, dst_file) WHERE (x.src, x.src_file) < (y.src, y.src_file))"""
_CANDIDATES = r"""cand AS (SELECT repo_key AS query, entry_id AS doc, repo_key || '#' || replace(file, '\', '/') AS file, row_number() OVER (PARTITION BY repo_key ORDER BY entry_id) AS place FROM entries WHERE repo_key IS NOT NULL)"""


def _arm(name: str) -> str:
    return f"""SELECT query, '{name}' AS arm, doc, new AS place FROM (SELECT c.query, c.doc, row_number() OVER (PARTITION BY c.query ORDER BY v DESC NULLS LAST, place, c.doc)::INT AS new
      FROM cand c LEFT JOIN sig USING (file)) WHERE new <= 20"""


SQL = {
    "j14_pairs": f"WITH {_VECTORS}, {_PAIRS.format('vectors', 0.85)} SELECT repo, a, b, round(similarity, 6) AS similarity FROM pairs",
    "j16_nearest": f"{_NEAR} SELECT repo, a, b, round(similarity, 6) AS similarity FROM near",
    "r21_duplicate_ratio": f"""WITH {_VECTORS}, {_CALLABLE}, {_PAIRS.format('callable', 0.80)}, {_NEAREST}
      SELECT repo, round(coalesce(hit, 0) / n, 6) AS ratio FROM (SELECT repo, count(DISTINCT id) AS n FROM callable GROUP BY repo)
      LEFT JOIN (SELECT repo, count(DISTINCT id) AS hit FROM (SELECT repo, a AS id FROM near UNION ALL SELECT repo, b FROM near) GROUP BY repo) USING (repo)""",
    "r20_drop_counts": f"""WITH {ENTRIES_SQL}, {_VECTORS}, {_CALLABLE}, {_PAIRS.format('callable', 0.80)}, {_NEAREST},
      about AS (SELECT coalesce(repo_key, '') AS repo, file, name, max(receiver) AS receiver, max(body) AS body FROM entries GROUP BY ALL),
      known AS MATERIALIZED (SELECT c.id, c.repo, c.name, c.kind, receiver, body FROM callable c JOIN about USING (repo, file, name)),
      called AS (SELECT DISTINCT repo, id AS src, unnest(regexp_extract_all(body, '\\b([A-Za-z_]\\w*)\\(', 1)) AS name FROM known WHERE body IS NOT NULL),
      calls AS MATERIALIZED (SELECT DISTINCT least(src, c.id) AS a, greatest(src, c.id) AS b FROM called JOIN callable c USING (repo, name)),
      marked AS (SELECT CASE WHEN regexp_matches(x.file, '{_TEST}') OR regexp_matches(y.file, '{_TEST}') THEN 'test' WHEN x.file = y.file THEN 'same_file' WHEN x.kind <> y.kind THEN 'kind'
          WHEN EXISTS (SELECT 1 FROM calls c WHERE c.a = n.a AND c.b = n.b) THEN 'calls'
          WHEN coalesce(p.name = q.name AND p.kind = 'method' AND q.kind = 'method' AND p.receiver <> q.receiver, false) THEN 'siblings' ELSE 'kept' END AS reason
        FROM near n JOIN callable x ON x.id = n.a JOIN callable y ON y.id = n.b LEFT JOIN known p ON p.id = n.a LEFT JOIN known q ON q.id = n.b)
      SELECT reason, count(*) AS pairs FROM marked GROUP BY reason""",
    "j22_common_interface": W + f", {_IMPLEMENT} SELECT * FROM kin",
    "j23_connected_pairs": W + f""", {_IMPLEMENT}, links AS (SELECT graph, src, src_file, dst, dst_file FROM edges WHERE label <> 'IMPLEMENTS')
      SELECT * FROM kin k WHERE EXISTS (SELECT 1 FROM links l WHERE l.graph = k.graph AND ((l.src = a AND l.src_file = a_file AND l.dst = b AND l.dst_file = b_file) OR (l.src = b AND l.src_file = b_file AND l.dst = a AND l.dst_file = a_file)))""",
    "r6_candidate_bm25": f"""{_E}, g AS MATERIALIZED (SELECT entry_id AS doc, name, file, {_grams('name')} AS a, {_grams('file')} AS b, {_grams("'" + ' '.join(TERMS) + "'")} AS q FROM entries WHERE name IS NOT NULL AND file IS NOT NULL),
      s AS (SELECT doc, name, file, {_jaccard('a', 'q')} AS ns, {_jaccard('b', 'q')} AS ps FROM g),
      near AS MATERIALIZED (SELECT doc, name, file FROM s WHERE ns > 0.1 OR ps > 0.1 ORDER BY round((2 * ns + ps) / 3, 6) DESC, doc LIMIT 200),
      tok AS MATERIALIZED (SELECT doc, {_tokens('name', True)} AS s, {_tokens('file', True)} AS p, coalesce(regexp_matches(file, '{_LOW}'), false) AS low FROM near),
      len AS (SELECT doc, low, 5.0 * len(s) + 5.0 AS length FROM tok), corpus AS (SELECT count(*) AS n, avg(length) AS mean FROM len),
      tf AS (SELECT doc, term, sum(w) AS tf FROM (SELECT doc, unnest(s) AS term, 5.0 AS w FROM tok UNION ALL SELECT doc, unnest(p), 5.0 FROM tok) WHERE list_contains({_WORDS}, term) GROUP BY ALL),
      df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
      SELECT doc, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf / CASE WHEN low THEN 5 ELSE 1 END) * 2.2 / (tf / CASE WHEN low THEN 5 ELSE 1 END + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score
      FROM tf JOIN df USING (term) JOIN len USING (doc), corpus GROUP BY doc ORDER BY score DESC, doc LIMIT 20""",
    "g15_graph_candidates": _PR + f""", syms AS MATERIALIZED (SELECT name, file, max(round(pagerank, 6)) AS pagerank, max(community) AS community, max(complexity) AS complexity FROM ranked JOIN symbols USING (graph, name, file) GROUP BY ALL),
      seeds AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY complexity DESC, name, file) AS place FROM syms ORDER BY complexity DESC, name, file LIMIT 5),
      step AS MATERIALIZED (SELECT DISTINCT src, dst, dst_file FROM calls),
      arm0 AS (SELECT name, file, row_number() OVER (ORDER BY pagerank DESC, name, file) AS place FROM (
        SELECT * FROM syms WHERE len(list_filter({_KEYS}, lambda w: contains(lower(name || chr(10) || file), w))) > 0 ORDER BY pagerank DESC, name, file LIMIT 20)),
      hop1 AS (SELECT DISTINCT place AS seed, dst AS name, dst_file AS file, 1 AS hop FROM step JOIN seeds ON src = name WHERE place <= 3),
      hop2 AS (SELECT DISTINCT seed, dst AS name, dst_file AS file, 2 AS hop FROM step JOIN (SELECT DISTINCT seed, name AS src FROM hop1) USING (src)),
      arm1 AS (SELECT name, file, seed * 1000 + rn AS place FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, name, file) AS rn FROM (
        SELECT seed, name, file, min(hop) AS hop FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2) GROUP BY ALL)) WHERE rn <= 10),
      home AS (SELECT community FROM syms WHERE name = (SELECT name FROM seeds WHERE place = 1) ORDER BY file LIMIT 1),
      arm2 AS (SELECT name, file, row_number() OVER (ORDER BY name, file) AS place FROM (SELECT name, file FROM syms WHERE community = (SELECT community FROM home) ORDER BY name, file LIMIT 20)),
      merged AS (SELECT name, file, part, place FROM (SELECT *, row_number() OVER (PARTITION BY name, file ORDER BY part, place) AS rn FROM (
        SELECT name, file, place, 0 AS part FROM arm0 UNION ALL SELECT name, file, place, 1 FROM arm1 UNION ALL SELECT name, file, place, 2 FROM arm2)) WHERE rn = 1)
      SELECT name, file, ['rank', 'calls', 'community'][part + 1] AS arm FROM merged m JOIN (SELECT name, file FROM syms) USING (name, file)
      WHERE NOT EXISTS (SELECT 1 FROM seeds s WHERE s.name = m.name AND s.file = m.file) ORDER BY part, place, name, file LIMIT 20""",
    "u1_first_of_each": f"""{_E}, own AS (SELECT * FROM entries WHERE complexity IS NOT NULL AND name IS NOT NULL AND file IS NOT NULL),
      l0 AS (SELECT file, name, entry_id, row_number() OVER (ORDER BY complexity DESC, file, name, entry_id) AS place FROM own QUALIFY place <= 50),
      l1 AS (SELECT file, name, entry_id, row_number() OVER (ORDER BY start_line DESC NULLS LAST, file, name, entry_id) AS place FROM own QUALIFY place <= 50)
      SELECT file, name, entry_id, place::INT AS place, part FROM (SELECT *, row_number() OVER (PARTITION BY file, name ORDER BY part, place) AS rn FROM (SELECT *, 0 AS part FROM l0 UNION ALL SELECT *, 1 FROM l1)) WHERE rn = 1""",
    "u2_nearest_of_each": f"""WITH {_VECTORS}, d AS (SELECT repo, file, round(1 - list_cosine_similarity(v, {PROBE}::DOUBLE[]), 6) AS distance, id FROM vectors WHERE v IS NOT NULL)
      SELECT repo, file, distance, id FROM (SELECT *, row_number() OVER (PARTITION BY repo, file ORDER BY distance, id) AS rn FROM d) WHERE rn = 1""",
    "r10_recency": f"WITH {ENTRIES_SQL}, {FILES_SQL}, {_CANDIDATES}, sig AS (SELECT concat_ws('#', repo, path) AS file, max(epoch(mod_time)::BIGINT) AS v FROM files GROUP BY 1) " + _arm("recency"),
    "r10_hotspot": rf"{_E}, {_CANDIDATES}, sig AS (SELECT repo_key || '#' || replace(file, '\', '/') AS file, max(c) AS v FROM (SELECT repo_key, file, round(avg(complexity), 6) AS c FROM entries WHERE kind IN ('function', 'method') GROUP BY ALL) GROUP BY 1) " + _arm("hotspot"),
    "r12_seed_weights": f"{_E}, {_NAMES}, {_SEEDS} SELECT * FROM seeds",
    "r13_boost": f"""{_E}, {_NAMES}, {_SEEDS}, hits AS (SELECT file, count(*) AS n FROM names WHERE len(list_filter({_KEYS}, lambda w: starts_with(name, w))) > 0 GROUP BY file)
      SELECT file, round(seed + 0.3 * coalesce(n, 0), 6) AS score FROM seeds LEFT JOIN hits USING (file)""",
    "g16_expand": f"""{_E}, {_CALLS}, {_NAMES}, {_SEEDS}, links AS MATERIALIZED (SELECT DISTINCT concat_ws('#', s.repo, caller_file) AS src, concat_ws('#', s.repo, h.file) AS dst FROM call_sites s JOIN homes h USING (repo, callee) WHERE caller_file <> h.file),
      s0 AS MATERIALIZED (SELECT file FROM seeds WHERE seed >= 3),
      d1 AS MATERIALIZED (SELECT DISTINCT dst AS file FROM links WHERE src IN (SELECT file FROM s0) AND dst NOT IN (SELECT file FROM s0)),
      d2 AS (SELECT DISTINCT dst AS file FROM links WHERE src IN (SELECT file FROM d1) AND dst NOT IN (SELECT file FROM s0 UNION ALL SELECT file FROM d1)),
      u1 AS MATERIALIZED (SELECT DISTINCT src AS file FROM links WHERE dst IN (SELECT file FROM s0) AND src NOT IN (SELECT file FROM s0)),
      u2 AS (SELECT DISTINCT src AS file FROM links WHERE dst IN (SELECT file FROM u1) AND src NOT IN (SELECT file FROM s0 UNION ALL SELECT file FROM u1)),
      walked AS (SELECT file, 0 AS distance, 0 AS o, 'seed' AS why FROM s0 UNION ALL SELECT file, 1, 0, 'imports' FROM d1 UNION ALL SELECT file, 2, 0, 'imports' FROM d2 UNION ALL SELECT file, 1, 1, 'imported_by' FROM u1 UNION ALL SELECT file, 2, 1, 'imported_by' FROM u2)
      SELECT file, distance, why FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY distance, o) AS rn FROM walked) WHERE rn = 1""",
    "x1_sibling_tests": rf"""WITH {FILES_SQL}, own AS MATERIALIZED (SELECT DISTINCT concat_ws('/', repo, path) AS file FROM files WHERE path IS NOT NULL),
      kept AS (SELECT file, regexp_extract(file, '^(.*?)\.[^./]+$', 1) AS stem, regexp_extract(file, '(\.[^./]+)$', 1) AS ext, regexp_extract(file, '^(.*/)?[^/]*$', 1) AS folder, regexp_extract(file, '([^/]*?)\.[^./]+$', 1) AS base
        FROM own WHERE NOT regexp_matches(file, '{_TEST}')),
      asked AS (SELECT file, unnest(CASE WHEN ext = '.go' THEN [stem || '_test.go'] WHEN ext = '.py' THEN [folder || 'test_' || base || ext, folder || 'tests/test_' || base || ext] WHEN ext = '.rs' THEN [stem || '_test.rs']
        WHEN ext IN ('.ts', '.tsx', '.js', '.jsx') THEN [stem || '.test' || ext, stem || '.spec' || ext] ELSE [] END) AS test FROM kept)
      SELECT test AS file, 0.8 AS score, min(file) AS of FROM asked WHERE test IN (SELECT file FROM own) AND test NOT IN (SELECT file FROM kept) GROUP BY test""",
    "x2_file_calls": W + "SELECT DISTINCT src_file AS src, dst_file AS dst FROM calls WHERE src_file <> dst_file",
    "t6_symbol_search": f"""{_E} SELECT entry_id, file, name, kind, (CASE WHEN lower(name) = 'merge' THEN 100 WHEN starts_with(lower(name), 'merge') THEN 50 WHEN contains(lower(name), 'merge') THEN 25 ELSE 10 END
      + CASE WHEN regexp_matches(name, '^\\p{{Lu}}') THEN 30 ELSE 10 END + CASE WHEN kind IN ('struct', 'interface', 'class') THEN 25 WHEN kind IN ('function', 'type') THEN 20 WHEN kind = 'method' THEN 15 WHEN kind = 'const' THEN 10 ELSE 5 END)::INT AS score FROM entries""",
    "t7_flagged_first": f"{_E}, {_CANDIDATES} SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY coalesce(complexity >= 10, false) DESC, place)::INT AS new_place FROM cand JOIN (SELECT entry_id AS doc, complexity FROM entries) USING (doc)",
    "t8_page": f"{_E} SELECT entry_id, name, complexity FROM entries ORDER BY complexity DESC NULLS LAST, entry_id LIMIT 20 OFFSET 40",
    "w7_threshold": f"""{_E} SELECT repo_key, complexity AS threshold FROM (SELECT repo_key, complexity, row_number() OVER (PARTITION BY repo_key ORDER BY complexity DESC) AS rn, count(*) OVER (PARTITION BY repo_key) AS n
      FROM entries WHERE complexity IS NOT NULL) WHERE rn = greatest(n // 10, 1)""",
}
