from __future__ import annotations

from pyspark.sql import functions as F

from lexforge.operators import documents, passes
from lexforge.sources import files


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_first_claim_and_leftovers(spark):
    items = spark.createDataFrame([("a",), ("b",)], "item string")
    claims = spark.createDataFrame([("a", "late", 2), ("a", "early", 1), ("zz", "early", 0)], "item string, holder string, pos int")
    assert rows(passes.place(items, claims, "item", "holder", "pos"), "item", "holder") == [("a", "early"), ("b", "uncategorized")]


def test_context_by_list_then_longest_folder(spark):
    f = spark.createDataFrame([("app/a/x.py",), ("app/a/b/y.py",), ("lib/z.py",), ("app/q.py",)], "path string")
    listed = spark.createDataFrame([("app/q.py", "Q")], "path string, context string")
    folders = spark.createDataFrame([("app", "A"), ("app/a/b", "B")], "folder string, context string")
    assert dict(rows(passes.resolve_context(f, listed, folders), "path", "context")) == {"app/a/x.py": "A", "app/a/b/y.py": "B", "lib/z.py": "support", "app/q.py": "Q"}


def test_routing_file_loses_its_copies(spark):
    r = [("routes.rb", ["a"]), ("routes.rb", ["b"]), ("routes.rb", ["c"]), ("x.rb", ["a"]), ("y.rb", ["b"]), ("z.rb", ["c"])]
    out = passes.routes_declared_elsewhere(spark.createDataFrame(r, "file string, segments array<string>"))
    assert {x for x, in rows(out, "file")} == {"x.rb", "y.rb", "z.rb"}


def test_ambiguous_word_stops_the_search(spark):
    e = spark.createDataFrame([(1, ["orders", "items"]), (2, ["items", "orders"]), (3, ["none"])], "id int, words array<string>")
    o = spark.createDataFrame([("orders", "O"), ("items", "A"), ("items", "B")], "word string, owner string")
    assert dict(rows(passes.owner_by_route(e, o, "id", "words"), "id", "owner")) == {1: None, 2: "O", 3: None}


def test_outdated_work(spark):
    work = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "id string, print string")
    sections = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "id string, print string")
    recorded = spark.createDataFrame([("a", "f", "h"), ("c", "g", "h")], "id string, path string, hash string")
    current = spark.createDataFrame([("f", "h"), ("g", "other")], "path string, hash string")
    cited = spark.createDataFrame([("a", "f"), ("c", "g")], "id string, path string")
    assert dict(rows(documents.outdated(work, sections, recorded, current, cited), "id", "outdated")) == {"a": False, "b": True, "c": True}


def test_renames_are_followed(spark):
    c = spark.createDataFrame([("new", 9, None), ("new", 5, "old"), ("new", 2, None), ("old", 4, None), ("old", 7, None)], "path string, seq bigint, renamed_from string")
    out = documents.renamed_log(c, spark.createDataFrame([("new",)], "start string"), 10)
    assert [(r["path"], r["seq"]) for r in out.orderBy("place").collect()] == [("new", 9), ("new", 5), ("old", 4)]


def test_water_filling():
    assert documents.water_fill({"a": 10, "b": 1000, "c": 1000}, {"a": 50, "b": 25, "c": 25}, 100) == {"a": 10, "b": 45.0, "c": 45.0}


def test_chunks_cover_the_text(spark):
    text = "".join(f"line {i}\n" + ("\n" if i % 7 == 0 else "") for i in range(80)) + "x" * 250
    out = documents.chunks(spark.createDataFrame([("a", text), ("b", None)], "k string, t string"), "k", "t", 100, 1000)
    got = [r["chunk"] for r in out.filter("k = 'a'").orderBy("nth").collect()]
    assert "".join(got) == text and max(map(len, got)) <= 100


def test_manifest_and_catalog(spark):
    df = spark.createDataFrame([("p", '{"name":"n","dependencies":{"x":"1"},"devDependencies":{"y":"2","x":"3"}}')], "path string, c string")
    r = documents.manifest(df, "path", "c").first()
    assert (r["name"], r["description"], r["dependencies"]) == ("n", None, ["x", "y"])
    df = spark.createDataFrame([("en", '{"a":{"b":"B","c":{"d":"D"}},"e":"E"}')], "path string, c string")
    assert dict(rows(documents.flat_catalog(df, "path", "c"), "key", "text")) == {"a.b": "B", "a.c.d": "D", "e": "E"}


def test_globs(spark):
    df = spark.createDataFrame([("a.md",), ("x/y/a.md",), ("x/a.py",)], "path string")
    hit = df.filter(F.col("path").rlike(files.glob_regex("**/*.md")))
    assert rows(hit, "path") == [("a.md",), ("x/y/a.md",)]
    assert rows(df.filter(F.col("path").rlike(files.glob_regex("x/*"))), "path") == [("x/a.py",)]
