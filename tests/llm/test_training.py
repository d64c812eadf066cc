"""Operators for training data: brute force, round trips, and rows that go wrong in every column."""

import datetime as dt
import functools
import math
import random

import numpy as np
import pandas as pd
import pytest
from compare import connect, differences
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cartolith.llm import bpe, canonical, docpairs, generated, neighbors, packing, queries, ranking, readability

NOW = dt.datetime(2025, 1, 1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows_as_sql(spark, small, name):
    assert differences(queries.queries()[name](spark, small), connect(small), queries.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", ["p1_found", "p6_found", "p7_ids", "p8_containers", "p9_found"])
def test_runs_on_whole_tables(spark, small, name):
    assert queries.queries()[name](spark, small).count() > 0


class TestCopies:
    schema = "entry_id bigint, body string, kind string, raw string, canon string, copies int"

    def members(self, spark, data):
        return rows(canonical.copy_members(spark.createDataFrame([(*r, "r", "c", 0) for r in data], self.schema)))

    def test_groups(self, spark):
        data = [
            (5, "a_b(1)", "function"), (3, "A B 1", "function"), (3, "A B 1", "function"), (9, "ab1​", None), (7, "ab2", "function"),
            (1, None, "function"), (2, "", "struct"), (4, "...", "struct"), (None, "ab1", "function"),
            (10, "S {\n x int;\n y int\n}", "struct"), (11, "s{y int, x int}", "struct"), (12, "s{x y, int int}", "struct"),
        ]
        assert self.members(spark, data) == [(10, 11), (3, 5), (3, 9)]
        counts = canonical.collapse_copies(spark.createDataFrame([(*r, "r", "c", 0) for r in data], self.schema))
        assert rows(counts) == [(10, 2), (12, 1), (3, 3), (7, 1)]

    def test_empty(self, spark):
        assert self.members(spark, []) == []

    def test_hot_text_and_long_text(self, spark):
        hot = spark.range(3000).select(F.col("id").alias("entry_id"), F.when(F.col("id") % 3 == 0, "x = 1").otherwise(F.concat(F.lit("y"), F.col("id"))).alias("body"), F.lit("function").alias("kind"))
        assert canonical.copy_members(hot).count() == 999
        long = spark.createDataFrame([(1, "ab " * 200_000, "function"), (2, "a_b\n" * 200_000, "function")], "entry_id bigint, body string, kind string")
        assert rows(canonical.copy_members(long)) == [(1, 2)]


class TestRanking:
    def scores(self, spark, data):
        df = spark.createDataFrame(data, "g string, i int, a double, b double, c double")
        return ranking.ideal_point_scores(df, "g", "i", ["a", "b", "c"])

    def test_no_score_wins_by_its_range(self, spark):
        data = [("x", 1, 1e6, 0.10, 1.0), ("x", 2, 10.0, 0.90, 9.0), ("x", 3, 8.0, 0.2, 2.0), ("x", 4, 5e5, 0.89, 8.5)]
        scored = self.scores(spark, data)
        assert rows(ranking.first_places(scored, "g", "i")) == [("x", 4)]

    def test_missing_ties_single_and_empty(self, spark):
        data = [("x", 1, None, math.nan, -1.0), ("x", 2, None, None, None), ("y", 1, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0), ("z", None, 1.0, 1.0, 1.0)]
        scored = self.scores(spark, data)
        assert rows(scored) == [("x", 1, 0.5), ("x", 2, 0.5), ("y", 1, 0.5)]
        assert rows(ranking.first_places(scored, "g", "i")) == [("x", 1), ("y", 1)]
        assert rows(self.scores(spark, [])) == []

    def test_places_of_a_large_group(self, spark):
        df = spark.range(5000).select(F.lit("g").alias("g"), "id", (F.col("id") % 1000 / 1000).alias("closeness"))
        placed = {r["id"]: r["place"] for r in ranking.ranked(df, "g", "id").collect()}
        order = sorted(range(5000), key=lambda k: (-(k % 1000) / 1000, k))
        assert all(placed[k] == n + 1 for n, k in enumerate(order))

    def test_places_of_many_equals(self, spark):
        df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "h").otherwise("g").alias("g"), "id", F.lit(0.5).alias("closeness"))
        placed = ranking.ranked(df.repartition(5), "g", "id").toPandas().sort_values(["g", "id"])
        assert all(own["place"].tolist() == list(range(1, len(own) + 1)) for _, own in placed.groupby("g"))

    def test_leader_of_a_large_investigation(self, spark):
        n = 20_000
        both, leads = F.abs(F.xxhash64("id")) % 1000, F.col("id") == n - 1
        own = [F.when(leads, 2000).otherwise(both + F.abs(F.xxhash64("id", F.lit(k))) % 800) for k in range(3)]
        made = spark.range(n).select(
            F.lit(1).alias("investigation_id"), F.col("id").alias("hyp_id"), F.lit("r").alias("repo_key"), F.concat(F.lit("f"), "id").alias("file"),
            own[0].alias("span_count"), (own[1] / 1e3).alias("anomaly_score"), F.lit(NOW).alias("reported_at"), own[2].alias("fused_score"),
        )
        research = made.select("investigation_id", F.col("file").alias("rel_path"), F.col("fused_score").cast("double"), F.lit(NOW).alias("scored_at"))
        scored = ranking.investigation_scores(made.drop("fused_score"), research).cache()
        assert scored.where("closeness = 1").count() > 20
        assert rows(ranking.first_places(scored, "investigation_id", "hyp_id")) == [(1, n - 1)]
        assert [r["hyp_id"] for r in ranking.ranked(scored, "investigation_id", "hyp_id").where("place = 1").collect()] == [n - 1]

    def test_exact_quantiles_of_large_groups(self, spark, monkeypatch):
        monkeypatch.setattr(ranking, "EXACT", 10)
        monkeypatch.setattr(ranking, "ERROR", 1 / 40)
        monkeypatch.setattr(ranking, "HOT", 500)
        df = spark.range(3000).select(
            F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 40)).alias("g"), F.col("id").alias("i"),
            F.when(F.col("id") % 7 > 0, F.xxhash64("id") % 1000 / 10).alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        )
        found = {r["g"]: (r["n"], r["a_q"], r["b_q"]) for r in ranking.exact_quantiles(df, ["a", "b"], (0.05, 0.95)).collect()}
        values = df.toPandas()
        assert set(found) == set(values.g)
        for g, own in values.groupby("g"):
            for c, q in (("a", 1), ("b", 2)):
                v = np.sort(own[c].dropna().to_numpy())
                assert found[g][q] == [v[max(1, math.ceil(p * len(v))) - 1] for p in (0.05, 0.95)], (g, c)
            assert found[g][0] == len(own)

    def test_the_norm_counts(self, spark):
        df = spark.range(200).select(F.lit("g").alias("g"), "id", (F.col("id") % 17).alias("a"), (1000 + F.col("id") % 23).alias("b"), F.pow(F.col("id") % 11, 3.0).alias("c"))
        plain = ranking.ranked(ranking.ideal_point_scores(df, "g", "id", ["a", "b", "c"]), "g", "id")
        larger = df.withColumn("c", F.col("c") * 1000)
        assert rows(plain) == rows(ranking.ranked(ranking.ideal_point_scores(larger, "g", "id", ["a", "b", "c"]), "g", "id"))

    def test_paths(self, spark):
        df = spark.createDataFrame([("./a\\b.go", "r"), ("/srv/checkouts/r/a/b.go", "r"), ("a/b.go", "r"), (None, "r"), ("a", None)], "f string, r string")
        assert [x[0] for x in df.select(ranking.clean_path(F.col("f"), F.col("r"))).collect()] == ["a/b.go"] * 3 + [None, "a"]


class TestNeighbors:
    schema = "vec_id bigint, repo_key string, file_path string, symbol_name string, updated_at timestamp, embedding array<float>, id int, vec string, q int"

    def table(self, spark, vectors):
        data = [(k, "r", "f", f"s{k}", NOW, v, 0, "", 1) for k, v in vectors]
        return spark.createDataFrame(data, self.schema)

    def test_against_brute_force(self, spark):
        random = np.random.default_rng(4)
        centres = random.standard_normal((40, 16))
        x = centres[random.integers(0, 40, 3000)] + 0.5 * random.standard_normal((3000, 16))
        found = neighbors.nearest_neighbors(self.table(spark, [(k, v.tolist()) for k, v in enumerate(x.astype("f4"))]), k=5, dimensions=16)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T
        np.fill_diagonal(near, -2)
        true = {(i, int(j)) for i in range(3000) for j in np.argsort(-near[i])[:5]}
        assert len(true & {(r["q"], r["d"]) for r in found.collect()}) / len(true) >= 0.9

    def test_copies_bad_vectors_and_versions(self, spark):
        base, other = [1.0, 0.0], [0.9, 0.1]
        data = [(k, base) for k in range(8)] + [(20, other), (21, None), (22, [1.0]), (23, [0.0, 0.0]), (24, [math.nan, 1.0])]
        df = self.table(spark, data).unionByName(
            spark.createDataFrame([(30, "r", "f", "s20", NOW - dt.timedelta(1), [0.0, 1.0], 0, "", 1), (None, "r", "f", "n", NOW, base, 0, "", 1)], self.schema)
        )
        found = {}
        for r in neighbors.nearest_neighbors(df.unionByName(df), k=5, least=0.9, dimensions=2).collect():
            found.setdefault(r["q"], []).append((r["place"], r["d"]))
        assert sorted(found) == [*range(8), 20]
        assert [d for _, d in sorted(found[7])] == [0, 1, 2, 3, 4] and [d for _, d in sorted(found[20])] == [0, 1, 2, 3, 4]
        assert sorted(p for p, _ in found[0]) == [1, 2, 3, 4, 5]

    def test_large_leaves_are_cut_into_blocks(self, spark, monkeypatch):
        monkeypatch.setattr(neighbors, "BLOCK", 50)
        random = np.random.default_rng(1)
        x = random.standard_normal((400, 4)).astype("f4")
        found = neighbors.nearest_neighbors(self.table(spark, [(k, v.tolist()) for k, v in enumerate(x)]), k=3, dimensions=4)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = unit @ unit.T
        np.fill_diagonal(near, -2)
        true = {(i, int(j)) for i in range(400) for j in np.argsort(-near[i])[:3]}
        assert len(true & {(r["q"], r["d"]) for r in found.collect()}) / len(true) > 0.98

    def test_empty(self, spark):
        assert neighbors.nearest_neighbors(self.table(spark, []), dimensions=2).count() == 0

    def test_queue_order(self):
        random = np.random.default_rng(2)
        x = random.standard_normal((500, 8)).astype("f4")
        forest = neighbors.fit_forest(x, 4, 2)
        leaves = neighbors.probe(x, forest, 6)
        assert all(len(set(row)) == 6 for row in leaves.tolist())
        assert (leaves[:, 0] < 16).all() and (leaves[:, 1] >= 16).all()


class TestDocumentation:
    schema = "entry_id bigint, name string, kind string, language string, file string, signature string, body string, doc_comment string, pos int, kind2 string, unit int"

    def pairs(self, spark, data):
        return rows(docpairs.documented_functions(spark.createDataFrame([(*r, 0, "k", 1) for r in data], self.schema)).select("entry_id", "description"))

    def test_where_descriptions_stand(self, spark):
        go = "func Load(a int) int {\n\treturn a // Keeps the old rows safe\n}"
        py = 'def load(a: int) -> int:\n    """Keeps rows that nobody else wants."""\n    return a'
        data = [
            (1, "Load", "function", "go", "a.go", "func Load(a int) int", go, "// Load drops broken rows early."),
            (2, "Load", "function", "go", "a.go", None, "// Load drops broken rows early.\n" + go, None),
            (3, "Load", "function", "go", "a.go", None, go, None),
            (4, "load", "function", "python", "a.py", None, py, None),
            (5, "load", "function", "python", "a.py", None, "def load(a):\n    # Keeps rows that nobody wants.\n    return a", None),
            (6, "Load", "function", "go", "a.go", "func Load(a int) int", "func Load(a int) int;", "// Load drops broken rows early."),
            (7, "Load", "function", "go", "a.go", None, "// Drops broken rows early.\n" + go, ""),
            (8, "Load", "struct", "go", "a.go", None, go, "// Load drops broken rows early."),
            (9, "x", "method", None, None, None, None, "Drops broken rows early."),
            (None, "x", "method", "go", "a.go", None, go, "Drops broken rows early."),
            (10, None, "method", "java", "A.java", None, "/** Counts broken rows early. */\npublic int x(List<String> a) { return 1; }", None),
        ]
        found = dict(self.pairs(spark, data + data))
        assert sorted(found) == [1, 2, 4, 10]
        assert found[4] == "Keeps rows that nobody else wants."
        assert self.pairs(spark, []) == []

    @pytest.mark.parametrize(
        ("text", "says"),
        [
            ("TODO: explain this", False), ("/** The load index function. */", False), ("// loadIndex loads index.", False), ("N/A", False),
            ("nolint:gocyclo", False), ("@param a\n@return", False), ("return a;", False), ("----", False), ("", False),
            ("# def other(a):\n#     x = 1  \n#     return x", False), ("Copyright the authors. All rights reserved.", False),
            ("Caps retries at 7.", True), ("@internal\nDrops old rows.", True), ("Liefert die Anzahl der Zeilen.", True),
            ("Ignoriert leere Pfade", True), ("返回已写入的行数", True), ("Deprecated: use the new form\nNever blocks the caller.", True),
        ],
    )
    def test_what_says_something(self, spark, text, says):
        df = spark.createDataFrame([(text,)], "t string")
        told = docpairs.says_something(docpairs.telling_text(F.col("t")), F.lit("loadIndex"), F.lit("func loadIndex(a int) int"))
        assert df.select(told).first()[0] is says

    def test_units_of_a_source_file(self, spark):
        text = "package a\n\n// One does this.\nfunc One() {\n\tif x { y() }\n}\n\n// Two does that.\nfunc Two() {}\n"
        src = spark.createDataFrame([(1, text, False)], "source_id int, text string, indented boolean")
        found = docpairs.delimited_functions(docpairs.lexed_tokens(src)).where("before <> ''").collect()
        assert any("Two does that" in r["before"] for r in found)


class TestEncoding:
    @staticmethod
    @functools.cache
    def both():
        """The public library with the same vocabulary, and the encoder."""
        import base64

        import tiktoken

        with open(f"{bpe.VOCABULARIES}/byte_bpe_50k.tiktoken", "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("own", pat_str=bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe.Encoder("byte_bpe_50k")

    @settings(max_examples=60, deadline=None)
    @given(st.text(max_size=200))
    def test_same_ids_as_the_public_library(self, text):
        reference, encoder = self.both()
        text = text.encode("utf-8", "ignore").decode()
        ids, offsets = encoder.encode([text, None, ""])
        assert ids[: offsets[1]].tolist() == reference.encode_ordinary(text)
        assert offsets.tolist()[1:] == [len(ids)] * 3

    def test_long_words_merge_alike(self):
        vocab = bpe.vocabulary("byte_bpe_50k")
        random.seed(3)
        for n in (2, 40, 255, 256, 257, 700, 3000):
            word = "".join(random.choice("etaoin=-" if n % 2 else "aab") for _ in range(n)).encode()
            cells = vocab.byte_ids[np.frombuffer(word, np.uint8)]
            assert bpe.merge_long(cells.copy(), vocab).tolist() == bpe.merge_matrix(cells[None, :].copy(), vocab)[0].tolist()

    def test_long_words_and_the_public_library(self):
        reference, encoder = self.both()
        random.seed(9)
        letters = ["aab", "etaoin", "xyzw", "abcdefghijklmnopqrstuvwxyz", "=", "-=", "\u00e4\u00f6", "0123456789"]
        for n in (257, 300, 600, 5000, 60_000):
            for choice in letters:
                text = "".join(random.choices(choice, k=n))
                ids, _ = encoder.encode([text])
                assert ids.tolist() == reference.encode_ordinary(text)

    def test_column(self, spark):
        df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, "y"), (2, "", "z")], "doc_id bigint, text string, ids string")
        assert rows(bpe.encode_documents(df)) == [(1, [64, 275]), (1, [64, 275]), (2, []), (None, [])]
        assert bpe.encode_documents(df.limit(0)).count() == 0
        with pytest.raises(FileNotFoundError):
            bpe.vocabulary("none")


class TestPacking:
    @settings(max_examples=80, deadline=None)
    @given(st.lists(st.integers(0, 100), max_size=80))
    def test_bins_hold_their_contents(self, sizes):
        where, capacity = packing.pack(sizes, [25, 50, 100])
        used = {}
        for size, container in zip(sizes, where, strict=True):
            used[container] = used.get(container, 0) + size
        assert all(used[c] <= capacity[c] for c in used)
        assert all(capacity[c] == min(p for p in (25, 50, 100) if p >= used[c]) for c in used)
        largest = packing.pack_by(sizes, [25, 50, 100], float("inf"))[1]
        assert sum(capacity.values()) <= sum(min(p for p in (25, 50, 100) if p >= u) for u in largest)

    def test_only_large_items_are_split(self, spark):
        items = spark.createDataFrame([(1, 250), (2, 100), (3, 30), (4, 0), (5, None), (6, -3), (None, 5), (3, 30)], "doc_id bigint, n_tokens bigint")
        packs = spark.createDataFrame([("p", 100), ("small", 50), ("bad", 0), ("none", None)], "pack_name string, capacity int")
        found = packing.fill_containers(items, packs).where("pack_name = 'p'").toPandas()
        assert found[found.doc_id == 1].sort_values("piece").length.tolist() == [100, 100, 50]
        assert found[found.doc_id == 2].length.tolist() == [100] and (found.doc_id == 3).sum() == 2
        assert set(found.doc_id) == {1, 2, 3, 4, 5, 6} and found.length.sum() == 410
        filled = found.groupby("container_id").agg(length=("length", "sum"), capacity=("container_capacity", "first"))
        assert (filled.length <= filled.capacity).all()
        assert packing.fill_containers(items.limit(0), packs).count() == 0

    def test_capacities_are_chosen_together(self):
        sizes = [500 + k * 37 % 480 for k in range(2000)]
        where, capacity = packing.pack(sizes, [384, 1000, 1536, 4096])
        largest = sum(min(p for p in (384, 1000, 1536, 4096) if p >= u) for u in packing.pack_by(sizes, [384, 1000, 1536, 4096], float("inf"))[1])
        assert len(set(capacity.values())) > 1 and sum(capacity.values()) < 0.97 * largest
        assert packing.opening_size(700, packing._Waiting([790] * 9), [1000, 1500, 4000], 0.0) == 1500

    def test_report(self, spark):
        items = spark.createDataFrame([(1, 250), (2, 100), (3, 30), (4, 0), (5, None), (None, 5), (3, 30)], "doc_id bigint, n_tokens bigint")
        packs = spark.createDataFrame([("p", 100), ("small", 50), ("bad", 0)], "pack_name string, capacity int")
        placed = packing.fill_containers(items, packs)
        kinds = ["pack_name", "items", "missing", "repeated", "split", "overfull", "used"]
        assert rows(packing.container_report(placed, items, packs).select(kinds)) == [("p", 5, 0, 0, 0, 0, 410), ("small", 5, 0, 0, 0, 0, 410)]
        short = placed.where("doc_id <> 2 OR pack_name <> 'p'")
        assert rows(packing.container_report(short, items, packs).select(kinds[:3]))[0] == ("p", 5, 1)

    def test_little_is_wasted(self, spark):
        items = spark.range(20000).select(F.col("id").alias("doc_id"), (F.abs(F.xxhash64("id")) % 300 + 1).alias("n_tokens"))
        packs = spark.createDataFrame([("p", 1000)], "pack_name string, capacity int")
        found = packing.fill_containers(items, packs)
        used = found.agg(F.sum("length"), F.count_distinct("container_id")).first()
        assert used[0] / (used[1] * 1000) > 0.98


class TestReadability:
    easy = "The dog runs to the big red box. We can see it now. It is a good day for us all. They sat on the mat and ate. He said we can go. I want to see the sun and the sea. The cat is not here now."
    hard = (
        "Notwithstanding considerable methodological heterogeneity, the systematic characterization of interdependent organizational "
        "representations necessitates an indispensable reconsideration of fundamental epistemological presuppositions, particularly "
        "insofar as accountability and interoperability are simultaneously required throughout the entire transformation hierarchy of the organization. "
    )

    def bands(self, spark, texts):
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("m", F.lit(1)).withColumn("words", F.lit("x"))
        return [r["band"] for r in readability.reading_levels(df).orderBy("doc_id").collect()]

    def test_bands(self, spark):
        code = "```\nfor x in items:\n    return the_value_of(x)\n```\n"
        wrapped = self.easy.replace("the big", "the\nbig")
        german = "Der Hund läuft zu der Kiste und wir sehen es. " * 12
        found = self.bands(spark, [self.easy, self.hard * 2, code * 30, None, "", " \n", "Too short for that.", german, wrapped, code + self.easy])
        assert found == ["basic", "advanced", None, None, None, None, None, None, "basic", "basic"]

    def test_syllables(self, spark):
        words = {"table": 2, "make": 1, "jumped": 1, "wanted": 2, "organization": 5, "idea": 3, "boxes": 2, "nation": 2, "queue": 1, "simple": 2}
        df = spark.createDataFrame([(w,) for w in words], "w string")
        found = {r[0]: r[1] for r in df.select("w", F.regexp_count(readability.divided(F.col("w")), F.lit("[aeiouy]+"))).collect()}
        assert sum(found[w] == n for w, n in words.items()) >= 8

    def test_school_years(self, spark):
        levels = spark.createDataFrame([(k, k / 2) for k in range(60)] + [(99, None)], "doc_id int, grade double")
        ratings = spark.createDataFrame([(k, 3 + k // 4) for k in range(0, 40, 2)] + [(3, None), (5, 900), (1000, 4)], "doc_id int, grade int")
        found = {r["doc_id"]: r["school_years"] for r in readability.with_school_years(levels, ratings).collect()}
        assert found[99] is None and abs(found[20] - 8) < 0.6 and found[0] >= 0 and len(found) == 61
        assert readability.with_school_years(levels, ratings.limit(5)).where("school_years IS NOT NULL").count() == 0
        assert readability.with_school_years(levels.limit(0), ratings).count() == 0

    def test_empty_and_long(self, spark):
        assert self.bands(spark, []) == []
        assert self.bands(spark, [self.easy * 2000, "a" * 100_000, "|" * 5000 + "\n" * 5000]) == ["basic", None, None]


class TestGenerated:
    def found(self, spark, files, symbols=None, upstream=()):
        f = spark.createDataFrame([(*x, NOW, "go") for x in files], "repo_key string, file_path string, content string, mod_time timestamp, tool string")
        s = spark.createDataFrame(symbols or [(x[0], x[1]) for x in files], "repo_key string, file_path string")
        u = spark.createDataFrame(list(upstream), "lib string, version string, path string, content string")
        return {(r["repo_key"], r["file_path"]): r["reason"] for r in generated.not_written_by_hand(s, f, u).collect()}

    code = "package a\n\nfunc Load(a int) int {\n\treturn a + 1\n}\n"

    def test_reasons(self, spark):
        lib = "package lib\n" + "".join(f"func F{k}(alpha{k} int) string {{ return compute{k}(alpha{k}, beta{k}) }}\n" for k in range(12))
        data = "var X = [\n" + "  0x17, 0x67, 0xd7, 0x60, 0x26,\n" * 40 + "]\n"
        files = [
            ("r", "a.go", "// Code generated by x. DO NOT EDIT.\n" + self.code), ("r", "b.go", "// Written by hand. Earlier versions were generated.\n" + self.code),
            ("r", "c.go", "// lib v1.2.3\n" + self.code), ("r", "d/e.go", lib), ("r", "x.pb.go", self.code), ("r", "node_modules/x/i.js", None),
            ("r", "t.go", data), ("r", "g.go", 'const HEADER = "Code generated by {tool}. DO NOT EDIT."\n' + self.code), ("r", "h.go", None), ("r", None, self.code),
            ("r", "src/codegen/printer.ts", self.code), (None, "a_pb2.py", ""), ("r", "win\\x.min.js", None),
        ]
        found = self.found(spark, files, upstream=[("lib", "1", "p", lib), (None, None, None, None)])
        assert found == {
            ("r", "a.go"): "notice", ("r", "c.go"): "notice", ("r", "d/e.go"): "copy", ("r", "x.pb.go"): "path", ("r", "node_modules/x/i.js"): "path",
            ("r", "t.go"): "data", (None, "a_pb2.py"): "path", ("r", "win\\x.min.js"): "path",
        }

    def test_notices_at_the_foot(self, spark):
        note = "Code generated by x v0.9. DO NOT EDIT."
        py = 'def load(a):\n    """Loads code that was generated by x."""\n    return a\n\n\nclass Stale(Exception):\n    """Raised for code generated by x."""\n'
        files = [
            ("r", "a.go", self.code + "// " + note), ("r", "b.go", self.code + f"\n/*\n {note}\n*/\n\n"), ("r", "c.go", self.code + "\n// lib v1.2.3\n"),
            ("r", "d.go", "// Part of the x suite.\n" + self.code + "\r\n// " + note + "\r\n"), ("r", "e.py", py), ("r", "f.py", py + f'"""\n{note}\n"""\n'),
            ("r", "g.go", self.code + "// Written by hand. Earlier versions were generated.\n"), ("r", "h.py", py + "    # Lines are generated by x.\n"),
        ]
        assert self.found(spark, files) == {("r", name): "notice" for name in ("a.go", "b.go", "c.go", "d.go", "f.py")}
        head, rest = generated.head_and_rest("// One.\n" + self.code + "\n// " + note + "\n")
        code, foot = generated.code_and_foot(rest)
        assert head == "// One." and code == self.code.rstrip() and foot.strip() == "// " + note
        for whole in ("", "/* a */ b(); /* c */", "/*! lib */function a(){}", ";(function(){})()", 'x = """\na\n"""'):
            assert generated.code_and_foot(whole) == (whole, "")

    def test_absent_files_repeats_and_empty(self, spark):
        files = [("r", "a.go", None), ("r", "a.go", "// @generated\n" + self.code)]
        assert self.found(spark, files, [("r", "a.go"), ("r", "a.go"), ("r", "vendor/z.go"), ("q", "z.go")]) == {("r", "a.go"): "notice", ("r", "vendor/z.go"): "path"}
        assert self.found(spark, [("r", "a.go", self.code)], [("r", "a.go")]) == {}

    def test_forest_on_held_out_labels(self, spark):
        random.seed(1)
        names = ["load", "parse", "merge", "total", "index", "cursor", "shard", "value"]

        def hand():
            return "// Part of the x suite.\n" + "".join(f"func {random.choice(names)}{k}({random.choice(names)} int) int {{\n\t// {' '.join(random.sample(names, 4))}\n\treturn {random.choice(names)}({k})\n}}\n" for k in range(random.randint(3, 9)))

        def tool():
            return "// rev 1 of api/x.proto\n" + "".join(f"func (m *M) GetField{k:03}() int32 {{ return m.field{k:03} }}\n" for k in range(random.randint(20, 60)))

        files = pd.DataFrame({"repo_key": "r", "path": [f"f{k}" for k in range(120)], "content": [hand() if k % 2 else tool() for k in range(120)]})
        known = spark.createDataFrame([], "upstream_id bigint, shingle bigint")
        evidence = generated.file_evidence(spark.createDataFrame(files), known).cache()
        train, held = evidence.where("path < 'f5'"), evidence.where("path >= 'f5'").withColumn("was", F.col("tool"))
        model = generated.train_forest(generated.labelled_files(train))
        votes = model.transform(generated._vectors(held)).select("path", "was", vector_to_array("probability")[1].alias("p")).toPandas()
        assert ((votes["p"] >= generated.LEAST_PROBABILITY) == votes["was"]).mean() >= 0.95
        again = generated.train_forest(generated.labelled_files(train.orderBy(F.desc("path")).repartition(7)))
        trees = [m.toDebugString.split("\n", 1)[1] for m in (model, again)]
        assert trees[0] == trees[1]

    def test_labels_of_one_kind(self, spark):
        known = spark.createDataFrame([], "upstream_id bigint, shingle bigint")
        files = spark.createDataFrame([("r", f"f{k}", self.code) for k in range(9)], "repo_key string, path string, content string")
        scored = generated.scored(generated.file_evidence(files, known))
        assert scored.where("probability IS NULL").count() == 9
        assert generated.scored(generated.file_evidence(files.limit(0), known)).count() == 0
