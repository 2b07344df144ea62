"""Operators without SQL against plain Python, stores on disk, and the cases that docstrings define."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import components, contexts, debt, evidence, figures, graphs, links, matching, selection, stores
from lexforge.sources import catalogs


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_chains_have_components_however_long(spark):
    edges = [(i, i + 1) for i in range(150)] + [(500, 499), (7, 7), (None, 3)]
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(151)}, 499: 499, 500: 499}
    pairs = spark.createDataFrame([(i, i + 1) for i in range(100)], "a bigint, b bigint")
    assert {r["part"] for r in graphs.with_parts(pairs).collect()} == {0}


def plain_pairs(texts, alike):
    words = {i: {w for w in t.lower().split() if len(w) > 3} for i, (_, t) in texts.items()}
    out = set()
    for a, b in itertools.combinations(sorted(texts), 2):
        if texts[a][0] and texts[b][0] and texts[a][0] != texts[b][0] and words[a] | words[b]:
            s = len(words[a] & words[b]) / len(words[a] | words[b])
            if s >= alike:
                out.add((a, b, round(s, 6)))
    return out


@pytest.mark.parametrize("alike", [0.6, 0.8])
def test_similar_statements_equal_all_pairs(spark, alike):
    r = random.Random(3)
    base = [[f"word{r.randrange(60)}" for _ in range(r.randrange(1, 14))] for _ in range(25)]
    texts = {}
    for i in range(140):
        w = list(r.choice(base))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = f"word{r.randrange(60)}"
        texts[i] = (r.choice(["a", "b", "c", None]), " ".join(w))
    df = spark.createDataFrame([(i, g, t) for i, (g, t) in texts.items()] + [(900, "a", ""), (901, "b", None)], "id bigint, g string, t string")
    got = {(r["a"], r["b"], round(r["similarity"], 6)) for r in matching.similar_statements(df, "id", "g", "t", alike).collect()}
    assert got == plain_pairs(texts, alike) and len(got) > 10


def test_merged_rules_keep_the_owner(spark):
    pairs = spark.createDataFrame([(1, 2, "f", "g", 0.9), (2, 3, "g", "h", 0.8), (1, 3, "f", "h", 0.7), (4, 5, "f", "g", 0.9), (5, 6, "g", "f", 0.8)], "a bigint, b bigint, ga string, gb string, similarity double")
    rules = [(1, "f-1", False, True, 3, ["x"], 0.4), (2, "g-1", True, False, 9, ["y"], None), (3, "h-1", False, True, 1, ["x", "z"], 0.9), (4, "f-2", False, False, 0, [], 0.1), (5, "g-2", False, False, 7, ["q"], None), (6, "f-3", True, True, 1, [], 1.0)]
    df = spark.createDataFrame(rules, "id bigint, slug string, owns boolean, backed boolean, files bigint, entities array<string>, confidence double")
    # 6 stays alone: its feature is that of 4.
    got = {r["keeper"]: (r["copies"], r["entities"], r["confidence"]) for r in graphs.merged_rules(pairs, df).collect()}
    assert got == {2: (2, ["y", "x", "z"], 0.9), 5: (1, ["q"], 0.1)}


def test_families_over_layers(spark):
    files = [f"app/rules/{n}.rb" for n in ("invoice", "refund", "shipping")] + [f"app/processes/{n}/start.rb" for n in ("invoice", "refund", "shipping")] + [f"app/tasks/{n}_task.rb" for n in ("invoice", "refund")] + ["app/rules/lonely.rb", "lib/odd.rb"]
    got = dict(map(tuple, contexts.family_groups(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame([("refund",)], "name string")).select("path", "family").collect()))
    assert got == {f: "invoice" for f in files if "invoice" in f}
    assert contexts.family_groups(spark.createDataFrame([], "path string"), spark.createDataFrame([], "name string")).count() == 0


def test_step_checks_tell_why(spark):
    files = spark.createDataFrame([("a.py", "def save():\n  order = 1\n"), ("b.py", None)], "path string, content string")
    steps = spark.createDataFrame([(1, "calls `save`"), (2, "calls `gone`"), (3, "saves the Order"), (4, "does it"), (5, "calls `save`"), (6, "calls `save`"), (7, "calls `save`")], "step int, text string")
    refs = spark.createDataFrame([(1, "a.py", 1, None), (2, "a.py", 1, 2), (3, "a.py", None, None), (4, "a.py", 1, 1), (5, "a.py", 3, 9), (6, "no.py", None, None)], "step int, path string, start_line int, end_line int")
    got = dict(map(tuple, debt.step_checks(steps, refs, files, spark.createDataFrame([("Order",), ("abc",)], "entity string")).collect()))
    assert got == {1: "pass", 2: "doubtful", 3: "pass", 4: "doubtful", 5: "broken", 6: "broken", 7: "ungrounded"}


def test_folders_of_entries(spark):
    got = [r["f"] for r in spark.createDataFrame([("src/a/b.py#GET /x",), ("b.py",), ("Class#method",), ("a/b",)], "e string").select(debt.folder_of(F.col("e")).alias("f")).collect()]
    assert got == ["src/a", ".", ".", "a"]


def plain_ranges(files, limit):
    out, start, at = [], 0, 0
    for _, g in itertools.groupby(files):
        n = len(list(g))
        to = at + n
        if n > limit:
            out += [(start, at)] if start < at else []
            out += [(c, min(c + limit, to)) for c in range(at, to, limit)]
            start = to
        elif to - start > limit:
            out.append((start, at))
            start = at
        at = to
    return out + ([(start, at)] if start < at else [])


def test_file_ranges_equal_a_plain_walk(spark):
    r = random.Random(8)
    data, want = [], []
    for g in range(12):
        files = [f"f{k:02d}" for k in range(r.randrange(1, 9)) for _ in range(r.randrange(1, 11))]
        data += [(g, i, f) for i, f in enumerate(files)]
        want += [(g, a, z) for a, z in plain_ranges(files, 4)]
    df = spark.createDataFrame(data, "g int, pos int, file string")
    assert rows(figures.file_ranges(df, "g", "pos", "file", 4), "g", "start", "end") == sorted(want, key=str)


def test_paragraphs_keep_fences(spark):
    text = "one\ntwo\n\n```\na\n\nb\n```\n\n\nlast"
    assert spark.createDataFrame([(text,)], "t string").select(evidence.paragraphs(F.col("t")).alias("p")).first()["p"] == ["one\ntwo", "```\na\n\nb\n```", "last"]


def test_paragraph_turns(spark):
    ranked = [("s", 0, 1, 7, 40), ("s", 0, 2, 2, 10), ("s", 1, 1, 7, 40), ("s", 1, 2, 5, 90), ("s", 1, 3, 3, 10)]
    df = spark.createDataFrame(ranked, "key string, query_no int, rank int, paragraph int, chars int")
    # 7 for the first query; 5 doesn't fit, so 3 for the second; then 2.
    assert rows(evidence.paragraph_choice(df, "key", 120, 10), "paragraph") == [(2,), (3,), (7,)]


def test_cited_entries_need_one_name(spark):
    entries = spark.createDataFrame([(1, "a#GET /x", "GET /x"), (2, "b#get /x", "get /x"), (3, "c#one", "one"), (4, "d#Two", "Two"), (5, "e#two", "Two")], "pos bigint, id string, name string")
    cited = spark.createDataFrame([("E3",), ("GET /x",), ("ONE",), ("two",), ("b#get /x",), ("E9",)], "cited string")
    assert rows(links.known_entries(cited, entries), "cited", "id") == [("E3", "c#one"), ("GET /x", "a#GET /x"), ("ONE", "c#one"), ("b#get /x", "b#get /x")]


def test_filters_that_are_absent_pass_all(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "kind string, n int")
    assert selection.keep(df, {"kind": None}).count() == 2 and selection.keep(df, {"kind": "a", "n": 2}).count() == 0


def test_pages_are_written_once(spark, tmp_path):
    plan = lambda s: spark.createDataFrame([("p", s)], "path string, status string")
    pages = spark.createDataFrame([("p", "text")], "path string, text string")
    assert stores.apply_plan(plan("created"), pages, f"{tmp_path}/pages") and not stores.apply_plan(plan("unchanged"), pages.limit(0), f"{tmp_path}/pages")
    assert spark.read.parquet(f"{tmp_path}/pages").count() == 1


def test_snapshots_are_saved_when_they_differ(spark, tmp_path):
    one, two = (spark.createDataFrame([("a", n)], "id string, n int") for n in (1, 2))
    path = f"{tmp_path}/runs"
    assert [stores.save_snapshot(spark, path, rows, run) for run, rows in ((1, one), (2, one), (3, two), (3, two))] == [True, False, True, True]
    assert rows(spark.read.parquet(path), "run", "n") == [(1, 1), (3, 2)]


def test_artifacts_are_read_leniently(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": 1}\nnot json\n{"a": 2, "b": "x"}\n')
    assert rows(catalogs.load_artifact(spark, str(tmp_path / "a.json"), "a int, b string"), "a", "b") == [(1, None), (2, "x")]
    assert catalogs.load_artifact(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_text_files_are_read_by_relative_path(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.md").write_text("# A\n")
    assert rows(catalogs.text_files(spark, str(tmp_path)), "path", "content") == [("sub/a.md", "# A")]


def test_prefixes_drop_cut_characters(spark):
    df = spark.createDataFrame([("café",), ("ab",), (None,)], "t string")
    assert [r["p"] for r in df.select(catalogs.prefix(F.col("t"), 4).alias("p")).collect()] == ["caf", "ab", None]


def test_languages_of_catalogs(spark):
    df = spark.createDataFrame([("config/locales/fr.yml",), ("i18n/de/app.json",), ("messages.properties",)], "p string")
    assert [r["l"] for r in df.select(catalogs.catalog_language(F.col("p")).alias("l")).collect()] == ["fr", "de", None]


def test_identifiers_in_prose(spark):
    df = spark.createDataFrame([("calls `push` then make_label, UserCart and run()",)], "t string")
    assert df.select(T.code_identifiers(F.col("t")).alias("x")).first()["x"] == ["push", "make_label", "UserCart", "run"]
