"""Operators on small tables made by hand."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cartolith.functions import complexity, predicates, stats, text
from cartolith.operators import duplicates, evaluation, graph_algorithms, history, incident, policy, quality, retrieval
from cartolith.operators.snapshots import next_in_order, snapshot_changes
from cartolith.plans import graph_queries, retrieval_queries
from cartolith.sources import scanners
from cartolith.sources.routes import normal_route
from cartolith.sources.tables import Graph
from cartolith.streaming import changes

SNAPSHOT = (
    "snapshot_id bigint, repo_key string, snapshot_at timestamp, symbols array<struct<n: string, k: string, f: string, c: int, x: int>>,"
    " edges array<struct<s: string, t: string, l: string>>, received_at timestamp, side string, hash int, item string"
)


def at(hour, day=1):
    return dt.datetime(2025, 1, day, hour)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, **columns):
    return tuple(spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first())


class TestSnapshots:
    def changes(self, spark, data):
        return rows(snapshot_changes(spark.createDataFrame([(*r, "x", 1, "y") for r in data], SNAPSHOT)))

    def test_added_removed_changed_and_clashing_columns(self, spark):
        first = ([("a", "f", "p", 1, 1), ("b", "f", "p", 1, None)], [("a:p", "b:p", "CALLS")])
        second = ([("a", "f", "p", 1, 2), ("c", "f", "p", 1, 0)], [("a:p", "c:p", "CALLS")])
        found = self.changes(spark, [(1, "r", at(1), *first, at(2)), (2, "r", at(3, 2), *second, at(4, 2))])
        assert found == [
            (2, "edge", "a:p|CALLS|b:p", "removed"), (2, "edge", "a:p|CALLS|c:p", "added"), (2, "symbol", "a:p", "changed"),
            (2, "symbol", "b:p", "removed"), (2, "symbol", "c:p", "added"),
        ]

    def test_failed_runs_redeliveries_and_repeated_keys(self, spark):
        a, b = [("a", "f", "p", 1, 0)], [("a", "f", "p", 9, 0), ("a", "f", "p", 1, None)]
        data = [
            (1, "r", at(1), a, [], at(2)), (1, "r", at(1), a, [], at(2)), (2, "r", at(3), None, None, at(4)),
            (3, "r", at(5), [], [], at(6)), (3, "r", at(5), b, [], at(7)),
        ]
        assert self.changes(spark, data) == []

    def test_nulls_and_empty(self, spark):
        assert self.changes(spark, []) == []
        data = [(None, "r", at(1), [], [], None), (1, "r", at(1), [None], None, None), (2, "r", at(2), [(None, None, None, None, None)], [], None)]
        assert self.changes(spark, data) == [(2, "symbol", ":", "added")]

    def test_neighbours_across_days(self, spark):
        df = spark.createDataFrame([(k, "r", at(1, k)) for k in (1, 2, 5)] + [(9, "r", at(2, 2)), (7, "s", at(1))], "id bigint, k string, t timestamp")
        found = {r["id"]: (r["prev_id"], r["next_id"]) for r in next_in_order(df, "k", "t", "id").collect()}
        assert found == {1: (None, 2), 2: (1, 9), 9: (2, 5), 5: (9, None), 7: (None, None)}


@pytest.fixture(scope="module")
def graph(spark):
    symbols = [(1, "r", n, f"p{n in 'cd'}/{n}.go", "function", int(n in "cd"), 3) for n in "abcde"]
    calls = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "b")]
    file = {s[2]: s[3] for s in symbols}
    return Graph(
        spark.createDataFrame(symbols, "graph bigint, repo string, name string, file string, kind string, community int, complexity int"),
        spark.createDataFrame(
            [(1, "CALLS", a, file[a], b, file[b]) for a, b in calls],
            "graph bigint, label string, src string, src_file string, dst string, dst_file string",
        ),
    )


class TestGraph:
    def test_pagerank_sums_to_one_and_matches_plain_python(self, spark, graph):
        found = {r["name"]: r["pagerank"] for r in graph_algorithms.pagerank(graph.symbols, graph.calls()).collect()}
        out = {"a": "b", "b": "c", "c": "d", "d": "b", "e": "b"}
        rank = dict.fromkeys("abcde", 0.2)
        for _ in range(20):
            rank = {n: 0.03 + 0.85 * sum(rank[s] for s, t in out.items() if t == n) for n in rank}
        assert sum(found.values()) == pytest.approx(1)
        assert found == pytest.approx(rank)

    def test_seeds_outside_the_graph_take_mass(self, spark, graph):
        seeds = spark.createDataFrame([(1, "a", "pFalse/a.go", 1.0), (1, "z", "z.go", 1.0)], "graph bigint, name string, file string, seed double")
        found = graph_algorithms.pagerank(graph.symbols, graph.calls(), seeds).agg(F.sum("pagerank")).first()[0]
        assert 0.4 < found < 0.6

    def test_impact_trace_and_depth(self, graph):
        found = {r["name"]: r for r in graph_algorithms.impact(graph).collect()}
        assert found["b"]["callers"] == 4 and found["d"]["depth"] == 3 and "a" not in found
        trace = graph_algorithms.trace_tree(graph.calls(), 5)
        assert trace.where("cycle").count() == 2  # from a and from e back to b
        assert {r["name"] for r in graph_algorithms.impact(graph, name="d").collect()} == {"d"}
        assert graph_algorithms.longest_chain(graph.calls()).first()["call_depth"] == 4  # a b, b c, c d, d b

    def test_no_edge_twice(self, spark):
        def depth(calls, **kw):
            edges = spark.createDataFrame([(g, a, "f", b, "f") for g, a, b in calls], "graph int, src string, src_file string, dst string, dst_file string")
            return dict(map(tuple, graph_algorithms.longest_chain(edges, **kw).collect()))

        cycle = [(1, "a", "b"), (1, "b", "c"), (1, "c", "a")]
        line = [(2, f"n{k}", f"n{k + 1}") for k in range(4)]
        long = [(3, f"n{k:02}", f"n{k + 1:02}") for k in range(14)]
        assert depth(cycle + line + long) == {1: 3, 2: 4, 3: 10}
        assert depth(cycle + long, large=5) == {1: 3, 3: 6}
        assert depth([(4, "a", "a"), (4, "a", "b")]) == {4: 2}
        assert depth([]) == {}

    @pytest.mark.parametrize("seeded", [False, True])
    def test_pagerank_in_tasks_and_by_joins(self, spark, seeded):
        nodes = spark.createDataFrame([(g, f"n{k}", "f") for g in (1, 2) for k in range(12)], "graph bigint, name string, file string")
        calls = [(g, f"n{k}", "f", f"n{k * k * g % 11}", "f") for g in (1, 2) for k in range(12) if k % 4] + [(1, "n1", "f", "away", "f"), (1, "n2", "f", "n3", "f")] * 2
        edges = spark.createDataFrame(calls, "graph bigint, src string, src_file string, dst string, dst_file string")
        seeds = spark.createDataFrame([(1, "n1", "f", 2.0), (1, "n5", "f", 1.0), (1, "zz", "f", 1.0)], "graph bigint, name string, file string, seed double") if seeded else None
        ranks = [
            {(r["graph"], r["name"]): r["pagerank"] for r in graph_algorithms.pagerank(nodes, edges, seeds, small=small).collect()}
            for small in (10**6, 0, 26)
        ]
        assert len(ranks[0]) == 24 and ranks[0] == pytest.approx(ranks[1], abs=1e-12) and ranks[0] == pytest.approx(ranks[2], abs=1e-12)

    def test_paths_between(self, graph):
        found = {(r["src"], r["dst"], r["hops"]) for r in graph_algorithms.paths(graph.calls(), 6, "a", "d").collect()}
        assert found == {("a", "d", 3)}
        everything = {(r["src"], r["dst"], r["hops"]) for r in graph_algorithms.paths(graph.calls(), 6).collect()}
        assert {r for r in everything if r[:2] == ("a", "d")} == found

    def test_trace_of_one_root(self, graph):
        found = graph_algorithms.trace_tree(graph.calls(), 5, root="c", symbols=graph.symbols.where("name <> 'b'")).collect()
        assert {(r["name"], r["depth"], r["unresolved"]) for r in found} == {("c", 0, False), ("d", 1, False), ("b", 2, True)}
        up = graph_algorithms.trace_tree(graph.calls(), 2, root="b", callers=True).collect()
        assert {(r["name"], r["depth"]) for r in up} == {("b", 0), ("a", 1), ("e", 1), ("d", 1), ("c", 2)}

    def test_flows(self, spark):
        def flows(symbols, calls, rank, handlers=()):
            g = Graph(
                spark.createDataFrame([(1, "r", n, f, "function", c, 1) for n, f, c in symbols], "graph bigint, repo string, name string, file string, kind string, community int, complexity int"),
                spark.createDataFrame([(1, "CALLS", *a, *b) for a, b in calls], "graph bigint, label string, src string, src_file string, dst string, dst_file string"),
            )
            ranked = spark.createDataFrame([(1, n, f, rank[n]) for n, f, _ in symbols], "graph bigint, name string, file string, pagerank double")
            handled = spark.createDataFrame([(1, *h) for h in handlers], "graph bigint, name string, file string")
            return {r["entry"]: (r["leaf"], r["members"], r["priority"]) for r in graph_algorithms.flows(g, ranked, handled).collect()}

        api, helper = ("PublicAPI", "api.go"), ("helper", "api.go")
        assert flows([(*api, 0), (*helper, 0)], [(api, helper)], {"PublicAPI": 0.5, "helper": 0.1}) == {"PublicAPI": ("helper", ["PublicAPI", "helper"], 0.5)}
        handler, query, caller = ("handleSearch", "server.go"), ("doQuery", "db.go"), ("caller", "main.go")
        found = flows([(*handler, 0), (*query, 0), (*caller, 0)], [(handler, query), (caller, handler)], {"handleSearch": 0.6, "doQuery": 0.2, "caller": 0.1}, [handler])
        assert set(found) == {"handleSearch"}
        entry, high, low = ("Entry", "a.go"), ("Important", "b.go"), ("Minor", "c.go")
        found = flows([(*entry, 0), (*high, 0), (*low, 0)], [(entry, high), (entry, low)], {"Entry": 0.5, "Important": 0.4, "Minor": 0.05})
        assert found["Entry"][0] == "Important" and "Important" not in found
        found = flows([(*entry, 0), (*high, 1)], [(entry, high)], {"Entry": 0.5, "Important": 0.4})
        assert found == {"Entry": ("Entry", ["Entry"], 0.5)}

    def test_long_paths(self, spark):
        calls = [(f"n{k}", f"n{k + 1}") for k in range(12)] + [(a, b) for a in "wxyz" for b in "wxyz" if a != b]
        edges = spark.createDataFrame([(1, a, "f", b, "f") for a, b in calls], "graph int, src string, src_file string, dst string, dst_file string")
        found = {(r["src"], r["dst"], r["hops"]) for r in graph_algorithms.paths(edges, 10).collect()}
        true, current = set(), [(a, b, {(a, b)}) for a, b in calls]
        for k in range(1, 11):
            true |= {(a, b, k) for a, b, _ in current}
            current = [(a, d, used | {(b, d)}) for a, b, used in current for c, d in calls if c == b and (b, d) not in used]
        assert found == true and ("n0", "n10", 10) in found

    def test_registered_depths(self, spark, small):
        queries = graph_queries.QUERIES
        assert queries["j8_call_chain"](spark, small).agg(F.max("hops")).first()[0] == 10
        assert queries["g8_trace"](spark, small).agg(F.max("depth")).first()[0] == 5

    def test_fusion_keeps_every_row(self, spark, small):
        asked = retrieval_queries.arms(spark, small).select("query", "doc").distinct()
        assert retrieval_queries.QUERIES["r8_rank_fusion"](spark, small).count() == asked.count()
        lists = spark.createDataFrame([("q", "semantic", "d", 1), ("q", "keyword", "d", 2), ("q", "keyword", "e", 1)], "query string, arm string, doc string, place int")
        assert {(r["doc"], r["source"]) for r in retrieval.fuse_ranks(lists, window=1).collect()} == {("d", "semantic"), ("e", "keyword")}
        assert {(r["doc"], r["source"]) for r in retrieval.fuse_ranks(lists).collect()} == {("d", "hybrid"), ("e", "keyword")}

    def test_bucket_in_parts(self, spark, monkeypatch):
        monkeypatch.setattr(history, "BUCKET_PART", 3)
        data = [(r, f"f{k}", dt.datetime(2025, 1, 1, h)) for r in "ab" for k in range(10) for h in range(k % 5 + 1)] + [("c", "z", dt.datetime(2025, 1, 2))]
        touched = {}
        for r, f, t in data:
            touched.setdefault((r, f), set()).add(t)
        true = {(*a, *b, len(x & y)) for a, x in touched.items() for b, y in touched.items() if a[0] < b[0] and len(x & y) >= 3}
        found = history.window_cochange(spark.createDataFrame(data, "repo string, file string, ts timestamp"))
        assert {(r["repo_a"], r["file_a"], r["repo_b"], r["file_b"], r["co"]) for r in found.collect()} == true

    def test_common_buckets_are_never_shuffled(self, spark):
        draw = random.Random(3)
        touched = {(repo, f"f{k}"): draw.sample(range(50), 3) for repo in "ab" for k in range(3000)}
        data = [(*key, dt.datetime(2025, 1, 1) + dt.timedelta(hours=h)) for key, hours in touched.items() for h in hours]
        touches = spark.createDataFrame(data, "repo string, file string, ts timestamp")
        store = spark.sparkContext._jsc.sc().statusStore()
        before = store.executorList(True).head().totalShuffleWrite()
        found = {(r["file_a"], r["file_b"], r["co"]) for r in history.window_cochange(touches).collect()}
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        assert store.executorList(True).head().totalShuffleWrite() - before < 5_000_000  # 1.6 million common buckets
        by = {}
        for (repo, file), hours in touched.items():
            by.setdefault((repo, tuple(sorted(hours))), []).append(file)
        assert found == {(f, g, 3) for (repo, hours), files in by.items() if repo == "a" for f in files for g in by.get(("b", hours), [])}

    @pytest.mark.parametrize("sparse", [0, 10**6])
    def test_pairs_of_parts(self, spark, monkeypatch, sparse):
        monkeypatch.setattr(history, "BUCKET_PART", 7)
        monkeypatch.setattr(history, "PAIRS_OUT", 5)
        monkeypatch.setattr(history, "SPARSE", sparse)
        draw = random.Random(5)
        data = [(draw.choice("abcdé"), f"f{draw.randrange(9)}", dt.datetime(1970, 1, 1) + dt.timedelta(hours=draw.randrange(-20, 20))) for _ in range(400)]
        data += [(r, f, t) for r, f, t in [(None, "f1", data[0][2]), ("a", None, data[0][2]), ("a", "f1", None)]]
        data += [("b", "everywhere", dt.datetime(1970, 1, 1) + dt.timedelta(hours=h)) for h in range(-20, 20)]
        touched = {}
        for r, f, t in data:
            if r and f and t and f != "everywhere":
                touched.setdefault((r, f), set()).add(t)
        true = {(*a, *b, len(x & y)) for a, x in touched.items() for b, y in touched.items() if a[0] < b[0] and len(x & y) >= 3}
        found = history.window_cochange(spark.createDataFrame(data, "repo string, file string, ts timestamp")).collect()
        assert {(r["repo_a"], r["file_a"], r["repo_b"], r["file_b"], r["co"]) for r in found} == true and len(found) == len(true) > 0

    def test_components(self, spark):
        pairs = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
        found = dict(map(tuple, graph_algorithms.components(pairs).collect()))
        assert {found[k] for k in range(1, 41)} == {1} and found[101] == 100

    def test_louvain_finds_two_cliques(self):
        edges = {(f"{s}{i}", f"{s}{j}"): 1.0 for s in "xy" for i in range(4) for j in range(i + 1, 4)} | {("x0", "y0"): 1.0}
        found = graph_algorithms.louvain_levels(edges, [f"{s}{i}" for s in "xy" for i in range(4)])
        assert len(set(found.values())) == 2 and len({found[f"x{i}"] for i in range(4)}) == 1

    def test_empty_graph(self, spark, graph):
        none = Graph(graph.symbols.limit(0), graph.edges.limit(0))
        assert graph_algorithms.pagerank(none.symbols, none.calls()).count() == 0
        assert graph_algorithms.impact(none).count() == 0
        assert graph_algorithms.louvain(none).count() == 0


class TestFunctions:
    def test_text(self, spark):
        assert one(spark, a=text.split_identifier(F.lit("parseHTTPHeader_v2 x")))[0] == ["parse", "http", "header"]
        assert one(spark, a=text.trigrams(F.lit("Ab")))[0] == ["  a", " ab", "ab "]
        assert one(spark, a=text.keywords(F.lit("Where is the Cache and the cache?")))[0] == ["cache"]
        assert one(spark, a=text.name_similarity(F.lit("abcd"), F.lit("abcx")))[0] == 0.75
        assert one(spark, a=text.common_prefix_folders(F.lit("a/b/c"), F.lit("a/b/d")))[0] == 2
        assert one(spark, a=text.truncate_lines(F.lit("ab\ncd"), 4), b=text.truncate_lines(F.lit("ab"), 4)) == ("ab", "ab")

    def test_stats(self, spark):
        values = one(spark, w=stats.wilson_lower(F.lit(5.0), F.lit(10.0)), z=stats.wilson_lower(F.lit(0.0), F.lit(0.0)))
        assert values == (pytest.approx(0.2366, abs=1e-4), 0.0)
        independent = one(spark, g=stats.log_likelihood(F.lit(25.0), F.lit(50.0), F.lit(50.0), F.lit(100.0)))[0]
        assert independent == pytest.approx(0)

    def test_predicates(self, spark):
        paths = spark.createDataFrame([("a/x_test.go",), ("test_x.py",), ("src/x.go",), ("a/x.pb.go",)], "p string")
        assert [r[0] for r in paths.select(predicates.is_test_file(F.col("p"))).collect()] == [True, True, False, False]
        assert [r[0] for r in paths.select(predicates.is_low_priority(F.col("p"))).collect()] == [True, True, False, True]
        assert one(spark, a=predicates.matches_glob(F.lit("a/b/c.go"), "a/**/*.go"), b=predicates.matches_glob(F.lit("a/b.go"), "*.py")) == (True, False)
        assert one(spark, a=predicates.matches_name(F.lit("ParseFile"), "parse*"))[0]
        assert one(spark, a=predicates.is_fix(F.lit("Hotfix: x")), b=predicates.is_fix(F.lit("prefix")))  == (True, False)
        assert one(spark, a=normal_route(F.lit("https://h/a/12/{id}//b/")))[0] == "/a/*/*/b"
        assert one(spark, a=predicates.is_generic_route(F.lit("/healthz")), b=predicates.is_generic_route(F.lit("/users/orders"))) == (True, False)

    def test_gitignore(self, spark):
        path = F.col("p")
        df = spark.createDataFrame([("build/x.o",), ("src/keep.log",), ("src/a.log",)], "p string")
        assert [r[0] for r in df.select(scanners.gitignored(path, ["# c", "build/", "*.log", "!keep.log"])).collect()] == [True, False, True]
        assert [r[0] for r in df.select(scanners.gitignored(path, ["build/", "*.log"])).collect()] == [True, True, True]


class TestScanners:
    def test_numstat_and_renames(self, spark):
        log = spark.createDataFrame([(1, "3\t1\tsrc/{old => new}/a.go"), (1, "-\t-\timg.png"), (1, "x")], "commit_id int, line string")
        assert rows(scanners.numstat_rows(log)) == [(1, "img.png", 0, 0), (1, "src/new/a.go", 3, 1)]
        assert rows(scanners.renames(log)) == [("src/old/a.go", "src/new/a.go")]

    def test_hunks(self, spark):
        diff = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +3,4 @@\n+a\n@@ -9 +10,0 @@\n-b\n@@ -20 +21 @@\n"
        df = spark.createDataFrame([(1, diff)], "diff_id int, text string")
        assert rows(scanners.diff_hunks(df)) == [(1, "x", 21, 21), (1, "x", 3, 6)]

    def test_json_sources(self, spark):
        metrics = '{"data": {"result": [{"metric": {"__name__": "m", "job": "j"}, "values": [[1700000000, "2.5"]]}]}}'
        found = scanners.metric_samples(spark.createDataFrame([(metrics,)], "json string")).first()
        assert (found["metric"], found["labels"], found["value"]) == ("m", {"job": "j"}, 2.5)
        trace = '{"data": [{"spans": [{"traceID": "t", "spanID": "s", "operationName": "o", "startTime": 5, "duration": 7, "tags": [{"key": "k", "value": "v"}, {"key": "k", "value": "w"}]}]}]}'
        found = scanners.trace_spans(spark.createDataFrame([(trace,)], "json string")).first()
        assert (found["operation"], found["duration"], found["tags"]) == ("o", 7, {"k": "v"})
        lines = spark.createDataFrame([("# c",), ("",), ('{"repo": "r", "query": "q", "expected_top_3": ["a"]}',)], "value string")
        assert rows(scanners.golden_records(lines)) == [("r", "q", None, ["a"])]

    def test_manifests_pins_layers(self, spark):
        data = [
            ("r", "go.mod", "module m\ngo 1.22\nrequire github.com/a/b v1.2.3 // indirect\nrequire (\n\tx.org/c v0.1.0\n)\n"),
            ("r", "web/package.json", '{"name": "w", "version": "9.9.9", "engines": {"node": "20.1.0"}, "dependencies": {"react": "^18.0.1"}}'),
            ("r", "web/a.tsx", "const r = createRoot(document.body)"), ("r", "b.go", "package b"),
            ("r", "Cargo.toml", '[package]\nname = "p"\nversion = "0.3.0"\nedition = "2021"\n[dependencies]\nserde = { version = "1.0", features = [] }\nrand = "0.8"\n[profile.release]\nlto = "2"\n'),
            ("r", "pyproject.toml", '[project]\nname = "q"\nversion = "1.2.3"\ndependencies = ["numpy>=1.20", "rich"]\n'), ("r", "pom.xml", "<version>7</version><dependency><artifactId>junit</artifactId><version>4.13</version></dependency>"),
            ("r", "Dockerfile", "FROM golang:1.22 AS b\nFROM $BASE\n"), ("r", "compose.yaml", "services:\n  x:\n    image: redis\n"),
        ]
        files = spark.createDataFrame(data, "repo string, path string, content string")
        assert {(r["name"], r["version"]) for r in scanners.manifest_dependencies(files).collect()} == {
            ("github.com/a/b", "v1.2.3"), ("x.org/c", "v0.1.0"), ("react", "18.0.1"), ("serde", "1.0"), ("rand", "0.8"), ("numpy", "1.20"), ("rich", None), ("junit", "4.13"),
        }
        pins = {(r["image"], r["tag"], r["unresolved"]) for r in scanners.image_pins(files).collect()}
        assert pins == {("golang", "1.22", False), ("$BASE", None, True), ("redis", None, False)}
        layers = scanners.detected_layers(files.where("path LIKE '%o.mod' OR path LIKE '%package.json'"), files)
        assert {(r["path"], r["layer"], r["role"]) for r in layers.collect()} >= {("web/package.json", "web", "client"), ("Dockerfile", ".", "library")}
        named = spark.createDataFrame([("r", "front", "web/", 2), ("r", "all", ".", 3), ("r", "first", "web", 1)], "repo string, layer string, root string, place int")
        assert {(r["path"], r["layer"]) for r in scanners.assigned_layers(files, named).collect()} >= {("web/a.tsx", "first"), ("b.go", "all")}
        assert {r["path"] for r in scanners.content_focused(files, ["ROOT"]).collect()} == {"web/a.tsx"}

    def test_walk(self, spark, tmp_path):
        (tmp_path / "src").mkdir()
        (tmp_path / "src/a.go").write_text("package a")
        (tmp_path / "b.png").write_bytes(b"x")
        (tmp_path / "src/b.go").write_text("package a")
        (tmp_path / "gen.go").write_text("package a")
        walked = scanners.walk_files(spark, str(tmp_path), ignore=["gen.go"], most=1)
        found = {r["path"]: (r["language"], r["skipped"]) for r in walked.collect()}
        assert found == {"src/a.go": ("go", None), "b.png": (None, "binary"), "gen.go": ("go", "ignored"), "src/b.go": ("go", "count")}
        assert rows(scanners.skip_counts(walked)) == [("binary", 1), ("count", 1), ("ignored", 1), ("kept", 1)]


class TestAnalytics:
    def test_cumulative_share_is_cume_dist(self, spark):
        df = spark.createDataFrame([(k, float(k // 2)) for k in range(10)], "id int, v double")
        found = {r["id"]: r["s"] for r in history.cumulative_share(df, "v", "s").collect()}
        assert found == {k: (k // 2 + 1) / 5 for k in range(10)}

    def test_changed_files(self, spark):
        schema = "repo string, path string, mod_time timestamp"
        a = spark.createDataFrame([("r", "x", at(1)), ("r", "y", at(1)), ("r", "n", None)], schema)
        b = spark.createDataFrame([("r", "y", at(2)), ("r", "z", at(1)), ("r", "n", None)], schema)
        assert rows(history.changed_files(a, b)) == [("r", "x", "removed"), ("r", "y", "changed"), ("r", "z", "new")]

    def test_fleet_counts_are_kept(self, spark):
        a = spark.createDataFrame([("i", "1"), ("i", "2"), ("j", "1")], "image string, tag string")
        b = spark.createDataFrame([("i", "1"), ("i", "3"), ("i", "4"), ("k", "1")], "image string, tag string")
        assert rows(incident.fleet_drift(a, b)) == sorted(
            [("i", "1", "1", "same", 1), ("i", "2", "3", "drift", 1), ("i", None, "4", "only_runtime", 1), ("j", "1", None, "only_source", 1), ("k", None, "1", "only_runtime", 1)], key=str
        )

    def test_operation_names(self, spark):
        df = spark.createDataFrame([("/pkg.Svc/Get",), ("GET /users/{id}",), ("main.(*S).Run-fm",)], "o string")
        assert [r[0] for r in df.select(incident.operation_function(F.col("o"))).collect()] == ["Get", "getUsers", "Run"]

    def test_filters_in_order(self, spark):
        schema = "symbol_a string, file_a string, kind_a string, symbol_b string, file_b string, kind_b string, calls boolean, siblings boolean, tags_disjoint boolean"
        pairs = spark.createDataFrame([("a", "x_test.go", "f", "b", "x_test.go", "m", True, True, True), ("a", "x.go", "f", "b", "y.go", "f", False, False, False)], schema)
        found = duplicates.first_failing_filter(pairs)
        assert rows(duplicates.drop_counts(found)) == [("kept", 1), ("test", 1)]

    matched = "id int, name string, kind string, file string, signature string, body string, body_hash bigint"

    def match(self, spark, a, b, near=None):
        sides = [spark.createDataFrame([(x + (None,) * 7)[:7] for x in side], self.matched) for side in (a, b)]
        return quality.greedy_matches(*sides, near)

    def test_matches_are_one_to_one(self, spark):
        a = [(1, "parseFile", "f"), (2, "parseFile", "f"), (3, "loadAll", "f")]
        found = rows(self.match(spark, a, [(7, "parseFile", "f"), (8, "parseFiles", "f"), (9, "other", "f")]).select("a_id", "b_id", "how"))
        assert found == [(1, 7, "exact"), (2, 8, "fuzzy"), (3, None, "gap"), (None, 9, "gap")]

    def test_matches_by_stage(self, spark):
        a = [(1, "ServeHTTP", "method"), (2, "NewServer", "function"), (3, "OnlyInA", "function")]
        b = [(1, "ServeHTTP", "method"), (2, "NewServer", "function"), (3, "OnlyInB", "type")]
        assert rows(quality.match_breakdown(self.match(spark, a, b))) == [("exact", "both", 2), ("gap", "only_a", 1), ("gap", "only_b", 1)]
        one = self.match(spark, [(1, "HandleRequest", "f")], [(1, "HandleRequests", "f")]).first()
        assert one["how"] == "fuzzy" and one["score"] >= 0.7
        assert self.match(spark, [(1, "HandleRequest", "f")], [(1, "HandleRequests", "g")]).where("how = 'gap'").count() == 2
        a = [(1, "parseFileX", "f"), (2, "parseFileY", "f")]
        b = [(7, "parseFileXa", "f"), (8, "parseFileXYZ", "f")]
        assert {(r["a_id"], r["b_id"]) for r in self.match(spark, a, b).collect()} == {(1, 7), (2, 8)}
        sig = "func (s *S) %s(ctx context.Context, key string, value []byte) error"
        a = [(1, "alpha", "f", "x.go", sig % "alpha", "b", 5), (2, "same", "f", "x.go", None, "b", 6), (3, "kept", "f", "x.go", None, "b", 7)]
        b = [(1, "omega", "f", "y.go", sig % "omega", "b", 5), (2, "same", "f", "x.go", None, "c", 9), (3, "kept", "f", "z.go", None, "b", 7)]
        found = {(r["a_id"], r["how"]): r["score"] for r in self.match(spark, a, b).collect()}
        assert set(found) == {(1, "renamed"), (2, "modified"), (3, "moved")} and found[1, "renamed"] > 0.92
        near = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 2, 0.78), (3, 2, 0.5)], "a_id int, b_id int, score double")
        found = self.match(spark, [(1, "abcdef", "f"), (2, "ghijkl", "f")], [(1, "mnopqr", "f"), (2, "stuvwx", "f")], near)
        assert rows(found.select("a_id", "b_id", "how")) == [(1, 1, "semantic"), (2, 2, "semantic")]
        assert self.match(spark, [], []).count() == 0

    def test_similar_texts_by_brute_force(self, spark):
        import random

        random.seed(6)
        words = ["".join(random.choice("abc") for _ in range(random.randint(1, 9))) for _ in range(160)]
        sides = [[(k, "f", w) for k, w in enumerate(words[s::2])] for s in (0, 1)]
        a, b = (spark.createDataFrame(s, "id int, kind string, text string") for s in sides)
        for least, gram in ((0.7, 2), (0.85, 3)):
            found = {(r["a_id"], r["b_id"]) for r in quality.edit_candidates(a, b, least, gram).collect()}
            scored = spark.createDataFrame([(i, j, x, y) for i, _, x in sides[0] for j, _, y in sides[1]], "i int, j int, x string, y string")
            true = {(r["i"], r["j"]) for r in scored.where(F.round(text.name_similarity(F.col("x"), F.col("y")), 6) >= least).collect()}
            assert found == true

    def test_grades(self, spark):
        perfect = {"files": 10, "avg_cognitive": 5.0, "avg_complexity": 3.0, "max_complexity": 8, "test_ratio": 0.3, "doc_ratio": 0.6, "avg_lines": 15.0, "error_ratio": 0.6, "max_nesting": 2}
        rest = {"large_ratio": 0.0, "duplication": 0.0, "magic_ratio": 0.0, "semantic_ratio": 0.0, "fresh_ratio": 0.8, "secure_ratio": 1.0, "total_deps": 10, "deps_scanned": True, "dead_code": 0}
        cases = [{}, {"files": 0}, {"fresh_ratio": 0.0}, {"fresh_ratio": 0.0, "secure_ratio": 0.0, "total_deps": 0}, {"fresh_ratio": 0.0, "secure_ratio": 0.0, "total_deps": 0, "deps_scanned": False}, {"dead_code": 5}, {"dead_code": 500}]
        data = [{**perfect, **rest, **c, "repo_key": str(k)} for k, c in enumerate(cases)]
        found = {r["repo_key"]: (r["score"], r["grade"]) for r in quality.grade(spark.createDataFrame(data)).collect()}
        assert found == {"0": (100, "A+"), "1": (0, "F"), "2": (94, "A+"), "3": (100, "A+"), "4": (88, "A"), "5": (98, "A+"), "6": (92, "A+")}
        assert sum(x[-1] for x in quality.GRADE) == pytest.approx(1)
        advice = rows(quality.recommendations(spark.createDataFrame([data[2]])))
        assert advice == [("2", "dep_freshness", 6.0, 6)]

    def test_dead_code_prior(self, spark):
        named = [("main", "a.go"), ("TestX", "a_test.go"), ("load", "examples/a.go"), ("work", "b.go"), ("used", "b.go")]
        symbols = spark.createDataFrame([(1, n, f, "function", 10) for n, f in named] + [(2, f"f{k:03}", "x.go", "function", k) for k in range(80)], "graph int, name string, file string, kind string, complexity int")
        called = spark.createDataFrame([(1, "used", "b.go")], "graph int, name string, file string")
        found = quality.dead_code_prior(symbols, called)
        assert {(r["name"], r["prior"]) for r in found.where("graph = 1").collect()} == {("main", 0.5), ("TestX", 0.1), ("load", 2.5), ("work", 10.0)}
        assert found.where("graph = 2").agg(F.count("*"), F.min("prior")).first() == (50, 30.0)

    bodies = [
        ("", "go", 0, 0, 0), ("func foo() { return 42 }", "go", 0, 0, 1), ("func f() {\n  if x {\n    for i := range y {\n      if z {\n      }\n    }\n  }\n}", "go", 6, 3, 0),
        ("func f() {\n  if a {\n  } else if b {\n  } else if c {\n  }\n}", "go", 3, 1, 0), ("func f() {\n  if a && b || c {\n  }\n}", "go", 3, 1, 0),
        ('func f() {\n  fmt.Println("if this were real")\n}', "go", 0, 0, 0), ('func f() {\n  sql := "WHERE a && b || c"\n  return sql\n}', "go", 0, 0, 0),
        ("func f() {\n  // if needed, add more\n  return 1\n}", "go", 0, 0, 0), (None, "go", 0, 0, 0),
        ("def foo(x):\n    if x > 0:\n        for i in range(10):\n            if i > x:\n                return i\n    return 0", "python", 6, 3, 1),
        ("x := 0\ny := -1\nz := 1.00", "go", 0, 0, 0), ("x := 0.5", "go", 0, 0, 1), ("x := $3 + $8", "go", 0, 0, 0), ("a := 30\nb := -42", "go", 0, 0, 2), ("const maxSize = 1024", "go", 0, 0, 0),
        ("x := 42 //nolint:mnd\ny := 100", "go", 0, 0, 1), ("a := m[3]\nx := arr[42]", "go", 0, 0, 1), ("const (\n A = 5\n)\nvar x = 9", "go", 0, 0, 1), ("x" * 50_000 + '"' + "y\\\\" * 20_000 + '"', "go", 0, 0, 0),
    ]

    def test_bodies(self, spark):
        df = spark.createDataFrame(self.bodies, "b string, l string, c int, n int, m int")
        b, l = F.col("b"), F.col("l")
        found = df.select("c", complexity.cognitive(b, l), "n", complexity.nesting(b, l), "m", complexity.magic_numbers(b, l)).collect()
        assert [(r[0], r[2], r[4]) for r in found] == [(r[1], r[3], r[5]) for r in found]

    def test_signatures(self, spark):
        data = [
            ("func (s *S) Do(ctx context.Context, f func(a, b int) error, m map[string]int) (int, error)", 3, True), ("def f(self, a, b=(1,2))", 2, False),
            ("func X()", 0, False), ("type A struct", 0, False), ("func Y(a int) error", 1, True), ("public Map<String, List<A>> f(Map<String, A> x, int y)", 2, False),
        ]
        df = spark.createDataFrame(data, "s string, n int, e boolean")
        assert all(r[0] == r[1] and r[2] == r[3] for r in df.select("n", complexity.parameters(F.col("s")), "e", complexity.returns_error(F.col("s"))).collect())

    def test_query_terms(self, spark):
        assert text.query_terms("what getUserName in HTTPServer2?") == ["what", "getusername", "httpserver2", "get", "user", "name", "http", "server"]
        df = spark.createDataFrame([("How the getUserName code file works, and works",)], "t string")
        assert df.select(text.keywords(F.col("t"))).first()[0] == ["getusername", "works"]
        tokens = spark.createDataFrame([("get_user", ["get", "user", "getuser"]), ("loadAll", ["loadall", "load", "all"]), ("auth", ["auth"])], "t string, w array<string>")
        assert all(r[0] == r[1] for r in tokens.select("w", text.field_tokens(F.col("t"), compact=True)).collect())

    def test_diverse_selection(self):
        c = [("a", 1.0, 5, frozenset("xy")), ("b", 0.9, 5, frozenset("xy")), ("c", 0.6, 5, frozenset("z")), ("d", 0.5, 50, frozenset("w"))]
        assert retrieval.diverse_selection(c, 10) == ["a", "c"]

    def test_dense_and_ranks(self, spark):
        v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0]), (4, None)], "id int, vec array<double>")
        assert [r["id"] for r in retrieval.dense_neighbours(v, [1.0, 0.0]).collect()] == [1, 3]
        arms = spark.createDataFrame([("q", "semantic", "x", 1), ("q", "keyword", "x", 2), ("q", "sparse", "y", 1)], "query string, arm string, doc string, place int")
        found = retrieval.fuse_ranks(arms).collect()
        assert [(r["doc"], r["source"]) for r in found] == [("x", "hybrid")]


class TestStreaming:
    def test_debounce_and_incremental_table(self, spark, tmp_path):
        source, table, mark = (str(tmp_path / x) for x in ("in", "table", "mark"))
        schema = "path string, ts timestamp, hash int"
        spark.createDataFrame([("a", at(1), 1), ("a", at(1), 2), ("b", at(2), 3)], schema).write.parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        index = lambda batch: batch.groupBy("path").agg(F.max("ts").alias("ts"), F.max("hash").alias("hash"))
        changes.incremental_index(stream, table, mark, index, ["path"], "ts").awaitTermination()
        spark.createDataFrame([("a", at(5), 9)], schema).write.mode("append").parquet(source)
        changes.incremental_index(stream, table, mark, index, ["path"], "ts").awaitTermination()
        assert rows(spark.read.parquet(table).select("path", "hash")) == [("a", 9), ("b", 3)]
        query = changes.debounced(stream).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("bursts").where("path = 'a'").count() >= 1

    def test_broken_scan_removes_nothing(self, spark):
        stored = spark.createDataFrame([(k,) for k in range(10)], "k int")
        assert changes.removed(stored, stored.where("k < 5"), ["k"]).count() == 0
        assert changes.removed(stored, stored.where("k < 8"), ["k"]).count() == 2

    def test_webhooks(self, spark):
        def event(action, login, kind):
            return (f'{{"action": "{action}", "number": 1, "repository": {{"full_name": "o/r"}}, "sender": {{"login": "{login}", "type": "{kind}"}}}}',)

        df = spark.createDataFrame([event("opened", "u", "User"), event("opened", "x[bot]", "Bot"), event("closed", "u", "User")], "json string")
        assert rows(changes.webhook_pushes(df)) == [("o/r", "opened", 1, "u")]
        import hashlib
        import hmac

        body = event("opened", "ü", "User")[0]
        for secret in ("key", "k" * 100):
            right = "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()
            sent = spark.createDataFrame([(body, right), (body + " ", right), (body, None), (None, right)], "json string, signature string")
            assert rows(changes.signed_deliveries(sent, secret)) == [(body, right)]


class TestEvaluationAndPolicy:
    def test_t_test(self, spark):
        assert evaluation.two_tailed(2.262157, 9) == pytest.approx(0.05, abs=1e-5)
        df = spark.createDataFrame([("x", 1.0, 2.0), ("x", 2.0, 2.5), ("x", 3.0, 4.5), ("y", 1.0, 1.0)], "g string, a double, b double")
        found = {r["g"]: r for r in evaluation.paired_t_test(df, "g", "a", "b").collect()}
        assert found["x"]["t"] == pytest.approx(3.4641, abs=1e-3) and found["x"]["p"] == pytest.approx(0.0742, abs=1e-3)
        assert found["y"]["t"] is None and found["y"]["p"] is None
        assert one(spark, a=evaluation.gate(F.lit(0.1), F.lit(0.01), F.lit(0.0), F.lit(0.5)), b=evaluation.gate(F.lit(0.1), F.lit(0.2), F.lit(0.0), F.lit(0.5))) == ("PASS", "FAIL")

    def test_rules(self, spark):
        imports = spark.createDataFrame([("r", "ui/a.go", "db/sql"), ("r", "db/b.go", "db/sql")], "repo string, file string, target string")
        rules = spark.createDataFrame([("no-db", "^ui/", "^db/")], "rule string, path_pattern string, import_pattern string")
        assert rows(policy.forbidden_imports(imports, rules)) == [("no-db", "r", "ui/a.go", "db/sql")]
        need = spark.createDataFrame([("docs", "^api/", "^docs/")], "rule string, when_pattern string, then_pattern string")
        changed = spark.createDataFrame([("r", "api/x"), ("s", "api/x"), ("s", "docs/y")], "repo string, file string")
        assert rows(policy.missing_companions(changed, need)) == [("docs", "r")]
        code = 'x = "// no" // yes\ny /* a\nb */ z'
        assert one(spark, a=policy.without_comments(F.lit(code)))[0] == 'x = "// no" \ny  z'

    def test_review(self, spark):
        symbols = spark.createDataFrame([("r", "f", "a", 1, 9), ("r", "f", "b", 20, 30)], "repo string, file string, name string, start_line int, end_line int")
        hunks = spark.createDataFrame([("r", "f", 9, 12)], "repo string, file string, start_line int, end_line int")
        changed = policy.changed_symbols(symbols, hunks)
        impact = spark.createDataFrame([("r", "f", "a", 25, "high")], "repo string, file string, name string, callers int, band string")
        found = rows(policy.review_risk(changed, impact, changed.limit(0)))
        assert found == [("r", "f", "a", 25, "untested,many_callers,high_impact", "high")]
