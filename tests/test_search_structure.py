"""Search, triage, structure, routes and sinks on small tables made by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartolith.functions import predicates
from cartolith.operators import duplicates, search, structure, vectors
from cartolith.sources import code_routes, scanners, sinks


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


class TestVectors:
    def test_pairs_and_neighbours_by_brute_force(self, spark):
        random = np.random.default_rng(3)
        centres = random.normal(size=(9, 64))
        data = [(f"r{k % 2}" if k % 7 else None, k, [float(x) for x in centres[k % 9] + 0.4 * random.normal(size=64)]) for k in range(180)]
        df = spark.createDataFrame(data, "repo string, id int, vec array<float>")
        v = {k: np.array(x, np.float32).astype(float) / np.linalg.norm(np.array(x, np.float32).astype(float)) for _, k, x in data}
        repo = {k: r or "" for r, k, _ in data}
        true = {(a, b) for a in v for b in v if a < b and repo[a] == repo[b] and v[a] @ v[b] >= 0.8}
        assert len(true) > 50
        for block in (1000, 17):
            assert {(r["a"], r["b"]) for r in vectors.pairs_within(df, 0.8, block).collect()} == true
        best = set()
        for a in v:
            near = sorted((b for b in v if b != a and repo[a] == repo[b] and v[a] @ v[b] >= 0.8), key=lambda b: -(v[a] @ v[b]))[:3]
            best |= {(min(a, b), max(a, b)) for b in near}
        assert {(r["a"], r["b"]) for r in vectors.nearest_within(df, 3, 0.8, 40).collect()} == best
        assert vectors.pairs_within(df.limit(0), 0.8).count() == 0

    def test_usable(self, spark):
        good, nan = [0.5] * 64, [float("nan")] + [0.5] * 63
        df = spark.createDataFrame([(good,), (nan,), ([0.0] * 64,), ([0.5] * 63,), (None,), ([None] + [0.5] * 63,)], "v array<float>")
        assert [r[0] for r in df.select(vectors.usable(F.col("v"))).collect()] == [True, False, False, False, False, False]


class TestTriage:
    def test_groups_and_tiers(self, spark):
        pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (7, 8, 0.82)], "a bigint, b bigint, similarity double")
        assert rows(duplicates.near_groups(pairs)) == [(1, 3, 0.85, "very_close"), (7, 2, 0.82, "related")]
        functions = spark.createDataFrame([("r", k) for k in range(1, 11)], "repo string, id bigint")
        assert rows(duplicates.duplicate_ratio(pairs.withColumn("repo", F.lit("r")), functions)) == [("r", 0.5)]

    def test_whole(self, spark):
        def vec(*x):
            return [float(v) for v in x] + [0.0] * (64 - len(x))

        data = [
            ("r", 1, "load", "a.go", "function", None, 5, vec(1, 0)), ("r", 2, "load2", "b.go", "function", None, 5, vec(1, 0.1)),
            ("r", 3, "save", "c.go", "function", None, 0, vec(0, 0, 1)), ("r", 4, "save2", "d.go", "function", None, 0, vec(0, 0, 1, 0.1)),
            ("r", 5, "open", "e_linux.go", "function", "(linux)", 0, vec(0, 0, 0, 0, 1)), ("r", 6, "open", "e_windows.go", "function", "(windows)", 0, vec(0, 0, 0, 0, 1)),
            ("r", 7, "t", "x_test.go", "function", None, 0, vec(0, 0, 0, 0, 0, 1)), ("r", 8, "t", "y.go", "function", None, 0, vec(0, 0, 0, 0, 0, 1)),
        ]
        df = spark.createDataFrame(data, "repo string, id bigint, name string, file string, kind string, tags string, body_hash bigint, vec array<float>")
        calls = spark.createDataFrame([(4, 3)], "src bigint, dst bigint")
        none = spark.createDataFrame([], "a bigint, b bigint")
        found = rows(duplicates.triage(df, calls, none))
        assert found == [("r", 1, 2, 0.995037, "very_close"), ("r", 1, 2, 1.0, "exact")]
        counts = dict(map(tuple, duplicates.drop_counts(duplicates.judged_pairs(duplicates.candidate_pairs(df), df, calls, none)).collect()))
        assert counts == {"kept": 1, "calls": 1, "build_tags": 1, "test": 1}
        assert duplicates.candidate_pairs(df, most=7).count() == 0

    def test_constraints(self):
        disjoint = duplicates.constraints_disjoint
        assert disjoint("linux", "windows") and disjoint("(linux && !cgo)", "cgo") and disjoint("arm64", "amd64 && linux")
        assert not disjoint("linux", "cgo") and not disjoint("linux || darwin", "darwin") and not disjoint(None, "linux") and not disjoint("!windows", "linux")
        assert not disjoint("linux; import os", "windows")

    def test_constraint_of_a_file(self, spark):
        df = spark.createDataFrame([("a_linux.go", "package a"), ("b.go", "//go:build cgo && !race\n\npackage b\n"), ("c.go", None), ("d_arm64_test.go", "x")], "p string, c string")
        assert [r[0] for r in df.select(duplicates.build_constraint(F.col("p"), F.col("c"))).collect()] == ["linux", "(cgo && !race)", None, "arm64"]

    def test_interfaces(self, spark):
        up = spark.createDataFrame([(1, "A", "f", "I", "i"), (1, "B", "f", "I", "i"), (1, "C", "f", "J", "i")], "graph int, src string, src_file string, dst string, dst_file string")
        assert rows(duplicates.common_interface_pairs(up)) == [(1, "A", "f", "B", "f")]
        types = spark.createDataFrame([(1, "I"), (2, "I"), (3, "J")], "type int, interface string")
        pairs = spark.createDataFrame([(1, 2), (1, 3)], "a int, b int")
        assert rows(duplicates.sharing_interface(pairs, types)) == [(1, 2)]


class TestSearch:
    def test_graph_candidates(self, spark):
        symbols = spark.createDataFrame([(n, f"{n}.go", c, p) for n, c, p in [("seed", 1, 0.1), ("mergeAll", 2, 0.5), ("callee", 2, 0.2), ("deep", 2, 0.2), ("peer", 1, 0.3), ("other", 3, 0.9)]], "name string, file string, community int, pagerank double")
        calls = spark.createDataFrame([("seed", "seed.go", "callee", "callee.go"), ("callee", "callee.go", "deep", "deep.go"), ("deep", "deep.go", "other", "other.go")], "src string, src_file string, dst string, dst_file string")
        seeds = spark.createDataFrame([("seed", "seed.go", 1)], "name string, file string, place int")
        found = [(r["name"], r["arm"]) for r in search.graph_candidates(symbols, calls, ["merge"], seeds).collect()]
        assert found == [("mergeAll", "rank"), ("callee", "calls"), ("deep", "calls"), ("peer", "community")]

    def test_seeds_and_boosts(self, spark):
        names = spark.createDataFrame([("a", "Merge"), ("a", "mergeShard"), ("b", "shard"), ("c", "x")], "file string, name string")
        assert rows(search.seed_weights(names, ["merge", "shard"])) == [("a", 12.0, 1.0), ("b", 10.0, 1.0)]
        scores = spark.createDataFrame([("a", 0.5)], "file string, score double")
        hits = spark.createDataFrame([("a",), ("a",), ("z",)], "file string")
        assert rows(search.boost_by_names(scores, hits)) == [("a", 1.1)]

    def test_expansion_keeps_its_direction(self, spark):
        links = spark.createDataFrame([("s", "d1"), ("d1", "d2"), ("u1", "s"), ("u1", "side"), ("x", "d1")], "src string, dst string")
        seeds = spark.createDataFrame([("s",)], "file string")
        assert rows(search.expand_files(seeds, links, 2)) == [("d1", 1, "imports"), ("d2", 2, "imports"), ("s", 0, "seed"), ("u1", 1, "imported_by")]

    def test_tests_beside_files(self, spark):
        kept = spark.createDataFrame([("p/a.go", 1.0), ("p/b.py", 0.5), ("c.tsx", 1.0), ("d_test.go", 1.0)], "file string, score double")
        there = spark.createDataFrame([("p/a_test.go",), ("p/test_b.py",), ("p/tests/test_b.py",), ("c.spec.tsx",), ("e_test.go",)], "file string")
        assert rows(search.sibling_tests(kept, there)) == [("c.spec.tsx", 0.8, "c.tsx"), ("p/a_test.go", 0.8, "p/a.go"), ("p/test_b.py", 0.4, "p/b.py"), ("p/tests/test_b.py", 0.4, "p/b.py")]

    def test_choice_within_a_budget(self, spark):
        data = [("q", "a", 1.0, 5, ["x", "y"]), ("q", "b", 0.9, 5, ["x", "y"]), ("q", "c", 0.6, 5, ["z"]), ("q", "d", 0.5, 50, ["w"]), ("p", "a", 1.0, 99, None)]
        df = spark.createDataFrame(data, "query string, id string, relevance double, size int, tokens array<string>")
        assert rows(search.choose_within_budget(df, 10)) == [("p", "a", 1), ("q", "a", 1), ("q", "c", 2)]

    def test_research(self, spark):
        ranked = spark.createDataFrame([("a.go", 0.9), ("b.go", 0.0)], "file string, score double")
        arm = spark.createDataFrame([("c.go", 0.7), ("a.go", 0.6)], "file string, score double")
        top = spark.createDataFrame([("t.go", 0.01), ("a.go", 0.9)], "file string, pagerank double")
        links = spark.createDataFrame([("a.go", "d.go"), ("e.go", "f.go")], "src string, dst string")
        names = spark.createDataFrame([("a.go", "mergeA"), ("d.go", "x")], "file string, name string")
        found = {r["file"]: (r["distance"], r["why"], r["score"]) for r in search.research(ranked, [arm], top, links, names, ["merge"]).collect()}
        assert set(found) == {"a.go", "c.go", "t.go", "d.go"}
        assert found["a.go"][2] == pytest.approx(1 / 61 + 1 / 62 + 0.3) and found["t.go"][2] == pytest.approx(0.08) and found["d.go"] == (1, "imports", 0.05)

    def test_ranks_and_pages(self, spark):
        df = spark.createDataFrame([("f", "merge", "function"), ("f", "MergeAll", "struct"), ("f", "x", "other")], "file string, name string, kind string")
        assert [(r["name"], r["score"]) for r in search.symbol_search(df, "merge").collect()] == [("merge", 130), ("MergeAll", 105), ("x", 25)]
        assert {r["score"] for r in search.symbol_search(df, "*").collect()} == {30, 55, 15}
        assert [r["name"] for r in search.page(df, ["name"], 1, 1).collect()] == ["merge"]
        ranked = spark.createDataFrame([(k, k) for k in range(1, 5)], "id int, place int")
        assert [r["id"] for r in search.flagged_first(ranked, F.col("id") % 2 == 0).orderBy("new_place").collect()] == [2, 4, 1, 3]
        v = spark.createDataFrame([("g", k) for k in range(1, 21)] + [("h", 5)], "g string, v int")
        assert rows(search.top_share_threshold(v, "v", "g")) == [("g", 19), ("h", 5)]


class TestStructure:
    def test_imports(self, spark):
        files = spark.createDataFrame([("r", p) for p in ("src/a/x.ts", "src/lib/util.ts", "src/a/y/index.ts", "pkg/ui/b.svelte", "app/mod.py")], "repo string, path string")
        aliases = spark.createDataFrame([("r", "$lib", "src/lib"), ("r", "@acme/ui", "pkg/ui")], "repo string, prefix string, root string")
        targets = {"$lib/util": "src/lib/util.ts", "./y": "src/a/y/index.ts", "../lib/util": "src/lib/util.ts", "@acme/ui/b": "pkg/ui/b.svelte", "virtual:pwa": None, "app.mod": "app/mod.py", "react": None, "$lib/none": None}
        imports = spark.createDataFrame([("r", "src/a/x.ts", t) for t in targets], "repo string, file string, target string")
        resolved = structure.resolved_imports(imports, files, aliases).cache()
        assert {r["target"]: r["resolved"] for r in resolved.collect()} == targets
        assert {(r["file"], r["packages"]) for r in structure.imported_by(resolved).collect()} == {("src/lib/util.ts", 1), ("src/a/y/index.ts", 1), ("pkg/ui/b.svelte", 1), ("app/mod.py", 1)}

    def test_cycles(self, spark):
        df = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "b", "a"), (2, "x", "y"), (2, "y", "z")], "graph int, src string, dst string")
        assert rows(structure.package_cycles(df)) == [(1, "a > b > c"), (1, "a > b")]
        assert rows(structure.has_cycle(df)) == [(1, True), (2, False)]
        assert structure.has_cycle(df.limit(0)).count() == 0
        assert rows(structure.focused_packages(df, "x", 1)) == [(2, "x", "y")] and structure.focused_packages(df, "x", 2).count() == 2
        assert rows(structure.roots_and_leaves(df)) == [(2, "x", "root"), (2, "z", "leaf")]

    def test_types_hooks_and_merges(self, spark):
        relations = spark.createDataFrame([("r", "S", "Base", "embeds", "p/a/s.go"), ("r", "S", "I", "implements", "p/a/s.go")], "repo string, subject string, target string, kind string, file string")
        symbols = spark.createDataFrame([("r", "Base", "q/b.go"), ("r", "Base", "p/a/b.go"), ("r", "I", "p/i.go")], "repo string, name string, file string")
        assert {(r["dst"], r["dst_file"], r["label"]) for r in structure.type_edges(relations, symbols).collect()} == {("Base", "p/a/b.go", "INHERITS"), ("I", "p/i.go", "IMPLEMENTS")}
        fires = spark.createDataFrame([("r", "save")], "repo string, hook string")
        handlers = spark.createDataFrame([("r", "save", "Base"), ("r", "init", "I"), ("r", "save", "gone")], "repo string, hook string, callback string")
        found = {(r["hook"], r["caller"], r["callee_file"]) for r in structure.hook_edges(fires, handlers, symbols).collect()}
        assert found == {("save", None, "q/b.go"), ("save", None, "p/a/b.go"), ("init", None, "p/i.go")}
        a = spark.createDataFrame([("x", "typed")], "k string, how string")
        b = spark.createDataFrame([("x", "text"), ("y", "text")], "k string, how string")
        assert rows(structure.merged_calls([a, b], ["k"])) == [("x", "typed"), ("y", "text")]

    def test_hidden_uses(self, spark):
        bodies = spark.createDataFrame([("r", "f", "user", 'x := Widget{}\nlog("Gadget")'), ("r", "f", "Widget", "Widget()"), ("q", "f", "far", "Widget")], "repo string, file string, name string, body string")
        names = spark.createDataFrame([("r", "Widget"), ("r", "Gadget"), ("r", "None")], "repo string, target string")
        assert rows(structure.hidden_callers(bodies, names)) == [("Gadget", "r", "f", "user", 0.4), ("Widget", "r", "f", "user", 0.6)]
        left = structure.without_string_uses(names.select("repo", F.col("target").alias("name")), bodies)
        assert rows(left) == [("r", "None")]

    def test_versions(self, spark):
        data = [("v1.2.3", "v1.2.3", "current"), ("1.2.3", "1.2.4", "patch"), ("1.2", "1.3.0", "minor"), ("v1.9.9", "v2.0.0", "major"), ("2.0.0", "1.9.0", "current"), (None, "1.0", "unknown"), ("main", "1.0", "unknown"), ("1.0.0-rc1", "1.0.0", "current")]
        df = spark.createDataFrame(data, "a string, b string, w string")
        assert [r for r in df.select("w", structure.version_change(F.col("a"), F.col("b")).alias("f")).collect() if r[0] != r[1]] == []

    def test_walk(self, spark):
        suspects = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "investigation_id int, subject string, place int")
        calls = spark.createDataFrame([("a", "c"), ("c", "d"), ("d", "e"), ("x", "a")], "src string, dst string")
        assert rows(structure.upstream_walk(suspects, calls, False, 1, 2)) == [(1, "c", 1, 0.3), (1, "d", 2, 0.15)]
        assert rows(structure.upstream_walk(suspects, calls, True, 3, 2)) == [(1, "x", 1, 0.3)]

    def test_overview_and_flags(self, spark):
        members = spark.createDataFrame([(1, f"n{k}", "f", k // 4) for k in range(9)], "graph int, name string, file string, detected int")
        assert rows(structure.community_overview(members, names=2)) == [(1, 0, 4, "n0,n1"), (1, 1, 4, "n4,n5")]
        symbols = members.select("graph", "name", "file")
        surprise = spark.createDataFrame([(1, "n1", "f", 0.5), (1, "n2", "f", 0.4)], "graph int, name string, file string, surprise double")
        assert rows(structure.graph_flags(symbols, symbols.where("name = 'n0'"), surprise)) == [(1, "n0", "f", "community_move"), (1, "n1", "f", "high_surprise")]


class TestRoutes:
    def test_languages(self, spark):
        src = [
            ("go", 'package main\n\nfunc main() {\n\thttp.HandleFunc("/api/users/{id}", s.users)\n\tmux.HandleFunc("GET example.com/api/data", data)\n\tr.Post("/login/now", login)\n\treq, _ := http.NewRequestWithContext(ctx, "PUT", "http://h/a/b", nil)\n}\n'),
            ("typescript", "app.get('/a/:id', show)\nfetch(`/api/x/${id}`)\r\naxios.post(\"/b/c\", d)\n@Get('cats/all')\n"),
            ("python", "@app.route('/p/<int:x>')\ndef f(): pass\n@router.get(\"/q/{y}\")\nrequests.get('http://s/t/u')\n"), ("java", '@GetMapping("/j/{id}")\n'),
            ("csharp", '[HttpGet("c/s")]\napp.MapPost("/m/n", h);'), ("ruby", "\nget '/r/b' do\n"), ("rust", '#[get("/ru/st")]\n.route("/ax/um", get(handler))\n'),
            ("html", '<div hx-get="/h/x"></div>\n<form action="/f/o">'), ("php", "add_action('init', 'my_init');\ndo_action( 'save' );"),
            ("javascript", "fetch('/Authorization')\nfetch('/A')\nfetch('/api/leak?c=')\nfetch('/0123456789abcdef0123456789abcdef')\n"), ("go", None), (None, "app.get('/x/y', z)"),
        ]
        df = spark.createDataFrame([("r", f"f.{language}", language, text) for language, text in src], "repo string, path string, language string, content string")
        found = {(r["file"][2:], r["line"], r["method"], r["path"], r["handler"], r["side"]) for r in code_routes.code_routes(df).collect()}
        assert found == {
            ("go", 4, "*", "/api/users/*", "s.users", "server"), ("go", 5, "GET", "/api/data", "data", "server"), ("go", 6, "POST", "/login/now", "login", "server"), ("go", 7, "PUT", "/a/b", None, "client"),
            ("typescript", 1, "GET", "/a/*", "show", "server"), ("typescript", 2, "*", "/api/x/*", None, "client"), ("typescript", 3, "POST", "/b/c", None, "client"), ("typescript", 4, "GET", "/cats/all", None, "server"),
            ("python", 1, "*", "/p/*", None, "server"), ("python", 3, "GET", "/q/*", None, "server"), ("python", 4, "GET", "/t/u", None, "client"), ("java", 1, "GET", "/j/*", None, "server"),
            ("csharp", 1, "GET", "/c/s", None, "server"), ("csharp", 2, "POST", "/m/n", None, "server"), ("ruby", 2, "GET", "/r/b", None, "server"), ("rust", 1, "GET", "/ru/st", None, "server"),
            ("rust", 2, "GET", "/ax/um", "handler", "server"), ("html", 1, "GET", "/h/x", None, "client"), ("html", 2, "*", "/f/o", None, "client"), ("php", 1, "*", "init", "my_init", "server"), ("php", 2, "*", "save", None, "client"),
        }

    def test_evidence(self, spark):
        pairs = spark.createDataFrame([("a", "s.go", "b", "c.ts"), ("a", "s.go", "b", "d.ts")], "repo_a string, file_a string, repo_b string, file_b string")
        data = [("a", "s.go", "GET", "/api/x", "server"), ("b", "c.ts", "*", "/api/x", "client"), ("b", "d.ts", "POST", "/api/x", "client"), ("a", "s.go", "GET", "/health", "server"), ("b", "d.ts", "GET", "/health", "client")]
        routes = spark.createDataFrame(data, "repo string, file string, method string, path string, side string")
        assert rows(code_routes.route_evidence(pairs, routes)) == [("a", "s.go", "b", "c.ts", "GET", "/api/x")]
        tokens = spark.createDataFrame([("a", "s.go", ["zeta", "beta", "alpha"]), ("b", "c.ts", ["beta", "zeta"]), ("b", "d.ts", [])], "repo string, file string, tokens array<string>")
        assert rows(code_routes.token_evidence(pairs, tokens, 1)) == [("a", "s.go", "b", "c.ts", ["beta"])]


class TestSources:
    def test_definitions(self, spark):
        src = {
            "go": ("func (s *S) Load(a int) {", "Load"), "python": ("    async def load(self):", "load"), "typescript": ("export default async function load() {", "load"), "javascript": ("const load = () => 1", "load"),
            "svelte": ("function load() {", "load"), "vue": ("export class Load {", "Load"), "astro": ("interface Props {", "Props"), "java": ("  public static List<String> load(int a) {", "load"),
            "csharp": ("public sealed record Load(int A);", "Load"), "rust": ("pub(crate) async fn load<T>(a: T) {", "load"), "ruby": ("  def self.load(a)", "load"), "php": ("  public static function load($a) {", "load"),
            "kotlin": ("suspend fun String.load(a: Int) = 1", "load"), "swift": ("public final class Load: Base {", "Load"), "c": ("static int load(struct x *a) {", "load"), "cpp": ("void Store::load(int a)", "load"),
        }
        df = spark.createDataFrame([("r", f"f{k}", language, f"\n{text}\n  x = y;") for k, (language, (text, _)) in enumerate(src.items())], "repo string, path string, language string, content string")
        found = {r["file"]: (r["name"], r["line"]) for r in scanners.extract_symbols(df).collect()}
        assert found == {f"f{k}": (name, 2) for k, (_, name) in enumerate(src.values())}

    def test_calls_and_relations(self, spark):
        data = [
            ("r", "a.go", "go", 'func Load() {\n\tx := db.Query("f(1)") // g()\n\tif ok(x) {\n\t}\n}'), ("r", "b.ts", "typescript", "class A<T> extends Base<T> implements I, J {\n}"),
            ("r", "c.py", "python", "class B(Base, mixins.M):\n    def run(self):\n        self.go()\nclass C(object):\n    pass"), ("r", "d.rs", "rust", "impl<T> Show for Thing<T> {\n}"), ("r", "e.kt", "kotlin", "class K : Base {"),
        ]
        df = spark.createDataFrame(data, "repo string, path string, language string, content string")
        calls = {(r["file"], r["line"], r["callee"], r["receiver"]) for r in scanners.call_rows(df.where("path IN ('a.go', 'c.py')")).collect()}
        assert calls == {("a.go", 2, "Query", "db"), ("a.go", 3, "ok", None), ("c.py", 3, "go", "self")}
        found = {(r["subject"], r["target"], r["kind"]) for r in scanners.type_relations(df).collect()}
        assert found == {("A", "Base", "extends"), ("A", "I", "implements"), ("A", "J", "implements"), ("B", "Base", "extends"), ("B", "mixins.M", "extends"), ("Thing", "Show", "implements"), ("K", "Base", "extends")}


class TestSinks:
    def test_texts(self, spark):
        edges = spark.createDataFrame([(1, "b", "a"), (1, "a", "c"), (1, "a", "c")], "graph int, src string, dst string")
        assert sinks.dot_text(edges).first()["text"] == 'digraph {\n  "a" -> "c";\n  "b" -> "a";\n}'
        assert sinks.mermaid_text(edges).first()["text"] == 'graph LR\n  n1["a"]\n  n2["b"]\n  n3["c"]\n  n1 --> n3\n  n2 --> n1'
        files = spark.createDataFrame([("r", "a/b/c.go"), ("r", "a/d.go")], "repo string, path string")
        assert sinks.tree_text(files).first()["text"] == "a\n  b\n    c.go\n  d.go" and sinks.tree_text(files, 2).first()["text"] == "a\n  b"
        findings = spark.createDataFrame([("r1", "high", "m", "f.go", 0), ("r1", "odd", "n", "a.go", 3)], "rule string, level string, message string, file string, line int")
        report = json.loads(sinks.findings_report(findings, "t").first()["json"])
        results = report["runs"][0]["results"]
        assert report["version"] == "2.1.0" and [x["level"] for x in results] == ["none", "error"] and results[1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 1

    def test_skeletons(self, spark):
        files = spark.createDataFrame([("r", "a.go", "package a\nfunc A() {\n\tx()\n}\nvar b = 1")], "repo string, path string, content string")
        symbols = spark.createDataFrame([("r", "a.go", 2, 4, "func A()"), ("r", "a.go", 3, 3, "x"), ("r", "a.go", 0, 9, "bad")], "repo string, file string, start_line int, end_line int, signature string")
        assert sinks.skeletons(files, symbols).first()["text"] == "package a\nfunc A() ...\nvar b = 1"

    def test_tables(self, spark, tmp_path):
        path = str(tmp_path / "t")
        sinks.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, "k")
        sinks.replace_partitions(spark.createDataFrame([("b", 3)], "k string, v int"), path, "k")
        assert rows(spark.read.parquet(path).select("k", "v")) == [("a", 1), ("b", 3)]
        symbols = spark.createDataFrame([(1, "n", "f", "function")] * 2, "graph int, name string, file string, kind string")
        edges = spark.createDataFrame([(1, "CALLS", "n", "f", "m", "f"), (1, "USES", "n", "f", "m", "f")], "graph int, label string, src string, src_file string, dst string, dst_file string")
        sinks.write_graph(symbols, edges, path)
        assert spark.read.parquet(f"{path}/symbols").count() == 1 and spark.read.parquet(f"{path}/edges").where("label = 'USES'").count() == 1
        stored = spark.createDataFrame([("a", 1, 1), ("b", 2, 2)], "k string, v int, w int")
        batch = spark.createDataFrame([("a", 9), ("b", None), ("c", 5)], "k string, v int")
        assert rows(sinks.updated(stored, batch, ["k"])) == [("a", 9, 1), ("b", 2, 2)]

    def test_guard(self):
        assert predicates.is_read_only("MATCH (n) RETURN n.settings") and not predicates.is_read_only("match (n) detach delete n") and not predicates.is_read_only("x set y")
