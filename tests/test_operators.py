from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import graphs, matching, ranking, retrieval, rollups, scoring
from lexforge.sources import files
from lexforge.streaming import incremental


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_search_by_half_rule_and_floor(spark):
    docs = spark.createDataFrame([(1, "Cancel plan\nStop a subscription and cancel it"), (2, "Create an invoice"), (3, "Subscription list"), (4, "Profile page"), (5, None)], "id int, text string")
    index = retrieval.build(docs, "id", "text")
    ask = lambda text, rule: rows(retrieval.search(index, spark.createDataFrame([(1, text)], "q int, t string"), "q", "t", rule), "rank", "doc")
    assert ask("how to cancel a subscription", "relevant")[0] == (1, 1)
    assert ask("zzzz", "any") == [] and ask("the of", "any") == []
    assert {d for _, d in ask("cancel subscription", "half")} == {1, 3}
    words = retrieval.unknown_words(index, spark.createDataFrame([(1, "the Zebra invoice zebra")], "q int, t string"), "q", "t")
    assert {r["word"] for r in words.collect()} == {"Zebra", "zebra"}


def test_greedy_fit_skips(spark):
    hits = spark.createDataFrame([(1, 1, 10, 5), (1, 2, 11, 9), (1, 3, 12, 4)], "q int, rank int, doc bigint, cost int")
    r = retrieval.greedy_fit(hits, ["q"], [F.col("rank")], F.col("cost"), 10).first()
    assert (r["used"], r["docs"]) == (9, [10, 12])


def test_paths_resolve_both_ways(spark):
    f = spark.createDataFrame([("src/a/x.py",), ("lib/x.py",), ("lib/y.py",)], "path string")
    c = spark.createDataFrame([("./lib/y.py",), ("y.py",), ("x.py",), ("repo/lib/y.py",), ("none.py",)], "cited string")
    assert dict(rows(matching.resolve_paths(c, f), "cited", "resolved")) == {"./lib/y.py": "lib/y.py", "y.py": "lib/y.py", "x.py": None, "repo/lib/y.py": "lib/y.py", "none.py": None}


def test_intervals_meet_once(spark):
    a = spark.createDataFrame([("f", 1, 1, 100), ("f", 2, None, None), ("g", 3, 5, 5)], "path string, id int, s int, e int")
    b = spark.createDataFrame([("f", 7, 50, 60), ("f", 8, 101, 102), ("g", 9, None, None)], "path string, id int, s int, e int")
    assert rows(matching.interval_overlaps(a, b, "path", "s", "e", 10), "a_id", "b_id") == [(1, 7), (2, 7), (2, 8), (3, 9)]


def test_freshness_states(spark):
    r = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "path string, hash string")
    c = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "path string, hash string")
    assert dict(rows(matching.freshness(r, c, "path"), "path", "state")) == {"a": "fresh", "b": "modified", "c": "deleted", "d": "unknown"}


def test_run_diff_thresholds(spark):
    old = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", 0.9), ("d", None), ("e", 0.5)], "id string, score double")
    new = spark.createDataFrame([("a", 0.75), ("b", 0.6), ("c", 0.7), ("d", 0.1), ("f", 0.5)], "id string, score double")
    assert dict(rows(ranking.run_diff(old, new, ["id"]), "id", "state")) == {"a": "same", "b": "degraded", "c": "degraded", "d": "same", "e": "removed", "f": "added"}


def test_islands_and_prefix_and_batches(spark):
    df = spark.createDataFrame([(i, v, s) for i, (v, s) in enumerate([("a", 5), ("a", 5), ("b", 20), ("a", 1)])], "pos int, v string, size int").withColumn("g", F.lit(1))
    out = ranking.islands(df, ["g"], [F.col("pos")], "v", 1)
    assert rows(out, "pos", "island", "batch") == [(0, 1, 0), (1, 1, 1), (2, 2, 0), (3, 3, 0)]
    assert rows(ranking.fitting_prefix(df, ["g"], [F.col("pos")], "size", 11), "pos") == [(0,), (1,)]
    assert rows(ranking.batches(df, ["g"], [F.col("pos")], "size", 11), "pos", "batch") == [(1, 0), (2, 0), (3, 1), (4, 2)]


def test_evenly_spaced(spark):
    df = spark.range(10).withColumn("g", F.lit(1))
    assert len(rows(ranking.evenly_spaced(df, ["g"], [F.col("id")], 3), "id")) == 3


def test_saved_order(spark):
    df = spark.createDataFrame([("n", 0, None), ("b", 1, 1), ("a", 2, 0)], "k string, pos int, old int")
    assert dict(rows(ranking.saved_order(df, "k", "pos", "old"), "k", "place")) == {"n": 0, "a": 1, "b": 2}


def test_child_confidence_missing_is_not_zero(spark):
    p = spark.createDataFrame([("x",), ("y",), ("z",)], "f string")
    c = spark.createDataFrame([("x", 0.5), ("x", None), ("y", None)], "f string, s double")
    assert rows(rollups.child_confidence(p, c, "f", "s"), "f", "confidence", "rationale") == [("x", 0.5, "1 of 2"), ("y", None, "0 of 1"), ("z", 0.0, "0 of 0")]


def test_recall_of_nothing_is_null(spark):
    none = spark.createDataFrame([], "name string")
    r = rollups.recall_precision(none, none, spark.createDataFrame([], "made string, wanted string")).first()
    assert r["recall"] is None and r["precision"] is None


def test_merge_is_complete_link(spark):
    p = spark.createDataFrame([(1, 2, "f", "g", 0.9, 1), (2, 3, "g", "h", 0.8, 1)], "a bigint, b bigint, ga string, gb string, similarity double, part bigint")
    assert rows(graphs.complete_link_merge(p), "id", "keeper") == [(1, 1), (2, 1), (3, 3)]


def test_slice_by_hops(spark):
    mentions = spark.createDataFrame([("a/s.py", "one", 2), ("a/s.py", "many", 9), ("a/one.py", "two", 1)], "src string, key string, n int")
    owners = spark.createDataFrame([("one", "a/one.py"), ("one", "b/one.py"), ("two", "c/two.py"), *[("many", f"m{i}.py") for i in range(7)]], "key string, dst string")
    e = graphs.name_edges(mentions, owners)
    starts = spark.createDataFrame([("a/s.py",)], "start string")
    assert rows(graphs.bounded_slice(e, starts, 1, 9), "node", "hop") == [("a/one.py", 1), ("b/one.py", 1)]
    assert ("c/two.py", 2) in rows(graphs.bounded_slice(e, starts, 2, 9), "node", "hop")


def test_set_apart(spark):
    df = spark.createDataFrame([(1, 0.79, 0.6), (2, 0.8, 0.59), (3, None, None)], "id int, b double, c double").select("id", scoring.set_apart_reasons(F.lit(False), F.col("b"), F.col("c")).alias("r"))
    assert rows(df, "id", "r") == [(1, ["technical language"]), (2, ["low confidence"]), (3, [])]


def test_sections_keep_fences(spark):
    text = "---\nt: x\n---\nintro\n# One\nbody\n```\n# not\n```\n## Empty\n# Two\r\nlast"
    got = files.sections(spark.createDataFrame([("d.md", text)], "path string, content string"))
    assert rows(got, "nth", "heading", "text") == [(0, None, "intro"), (1, "One", "# One\nbody\n```\n# not\n```"), (2, "Two", "# Two\nlast")] or [r[1] for r in sorted((r["nth"], r["heading"]) for r in got.collect())] == [None, "One", "Two"]


def test_phrases_and_definitions(spark):
    text = "describe('cart', () => {\n  it \"adds\"\n  items 'no'\ndef test_pays_once():\nclass CartItem:\n    def total(self):"
    df = spark.createDataFrame([("a.py", text)], "path string, content string")
    assert df.select(files.phrases(F.col("content")).alias("p")).first()["p"] == ["cart", "adds", "pays once"]
    assert [(r["kind"], r["name"]) for r in files.definitions(df, "path", "content").orderBy("line").collect()][1:] == [("class", "CartItem"), ("def", "total")]


def test_file_kinds(spark):
    df = spark.createDataFrame([("a/b.md",), ("src/x.py",), ("tests/x.py",), ("x_test.go",), ("build.gradle.kts",), ("v.blade.php",), (".py",)], "path string").select("path", files.file_kind(F.col("path")).alias("k"))
    assert dict(rows(df, "path", "k")) == {"a/b.md": "markdown", "src/x.py": "source", "tests/x.py": "test", "x_test.go": "test", "build.gradle.kts": "other", "v.blade.php": "other", ".py": "other"}


def test_usage_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("select timestamp'2024-01-01 00:10:00' ts, 'p' pass, 1 n union all select timestamp'2024-01-01 00:50:00', 'p', 2").write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, pass string, n int").parquet(src)
    q = incremental.usage_windows(stream, "ts", ["pass"], ["n"]).writeStream.outputMode("complete").format("memory").queryName("usage").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert rows(spark.table("usage"), "pass", "calls", "n") == [("p", 2, 3)]
