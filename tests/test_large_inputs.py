"""Inputs of the size at which plans once failed, held against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from lexforge import catalog
from lexforge.operators import contexts, matching, reach
from lexforge.sources import catalogs, files


def test_schema_blocks_of_many_lines(spark):
    names = [f"c{i}" for i in range(40_000)]
    text = 'ActiveRecord::Schema.define do\n  create_table "big" do |t|\n' + "".join(f'    t.string "{n}"\n' for n in names) + '  end\n  create_table "next" do |t|\n    t.string "x"\n  end\nend\n'
    got = catalogs.active_record_tables(spark.createDataFrame([(1, text)], "id int, content string"), "id", "content").collect()
    assert [(r["table_no"], r["name"], r["columns"]) for r in got] == [(0, "big", names), (1, "next", ["x"])]


def test_sql_tables_of_many_lines(spark):
    names = [f"c{i}" for i in range(40_000)]
    text = 'CREATE TABLE "app".big (\n' + "".join(f"  `{n}` int,\n" for n in names) + "  PRIMARY KEY (id)\n);\nCREATE TABLE next (\n  x int\n);\n"
    got = files.sql_tables(spark.createDataFrame([(1, text)], "id int, content string"), "id", "content").collect()
    assert [(r["table_no"], r["name"], r["columns"]) for r in got] == [(0, "app.big", names), (1, "next", ["x"])]


@pytest.mark.parametrize("most", [contexts.ENTITY_BYTES, 0])
def test_features_are_never_broadcast(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(contexts, "ENTITY_BYTES", most)
    spark.createDataFrame([(i, f"Handles blue ring {i % 7}") for i in range(3000)], "pos bigint, text string").write.parquet(f"{tmp_path}/f")
    spark.createDataFrame([(f"Blue{'x' * 100}{i}",) for i in range(20000)] + [("Blue Ring",), ("ring 3",)], "entity string").write.parquet(f"{tmp_path}/e")
    out = contexts.entities_of_code(spark.read.parquet(f"{tmp_path}/f"), spark.read.parquet(f"{tmp_path}/e"), "pos", "text")
    assert {tuple(r) for r in out.collect()} == {(i, "Blue Ring") for i in range(3000)} | {(i, "ring 3") for i in range(3, 3000, 7)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and ("BuildRight" in plan) == (most > 0)


def long_texts():
    r = random.Random(8)
    base = [[f"word{r.randrange(4000)}" for _ in range(r.randrange(60, 200))] for _ in range(12)]
    texts = {}
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.randrange(0, len(w) // 3)):
            w[r.randrange(len(w))] = f"word{r.randrange(4000)}"
        texts[i] = (r.choice("abc"), " ".join(w))
    texts |= {i: (r.choice("abc"), texts[0][1]) for i in range(150, 170)}  # copies
    texts |= {i: ("abc"[i % 3], " ".join([f"shared{i % 2}"] + [f"own{i}x{k}" for k in range(80)])) for i in range(200, 300)}  # one rare word in common
    return texts


def test_only_pairs_with_several_words_in_common_meet_their_sets(spark, monkeypatch):
    seen, kept = [], matching.kept
    monkeypatch.setattr(matching, "kept", lambda d: seen.append(kept(d)) or seen[-1])
    texts = long_texts()
    words = {i: set(t.split()) for i, (_, t) in texts.items()}
    want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a in texts for b in texts if a < b and texts[a][0] != texts[b][0]}
    want = {p: s for p, s in want.items() if s >= 0.6}
    out = matching.similar_statements(spark.createDataFrame([(i, g, t) for i, (g, t) in texts.items()], "id bigint, g string, t string"), "id", "g", "t").collect()
    assert {(r["a"], r["b"]): r["similarity"] for r in out} == want and len(out) == len(want) > 300
    pairs = [d.count() for d in seen if {"a", "b"} <= set(d.columns)]
    assert pairs and max(pairs) < 2000  # 2,450 more share one word


def test_rule_duplicates_look_up_their_own_lines(spark):
    said = [" ".join(f"word{k}x{i}" for i in range(12)) for k in range(30)]
    rules = [(3 * k + j, f"f{j}", said[k] if j == 0 else said[k].replace("x1", "y1") if j == 1 else said[k]) for k in range(30) for j in range(3)]
    r = random.Random(2)
    code = [(p, f"file{p // 3 % 2}", *r.choice([(5, 9), (9, 12), (13, 20), (None, 4), (3, None), (20, 22)])) for p in range(90)]
    out = matching.rule_duplicates(spark.createDataFrame(rules, "pos bigint, feature string, statement string"), spark.createDataFrame(code, "pos bigint, path string, start bigint, end bigint"), alike=0.5)
    words = {p: set(t.split()) for p, _, t in rules}
    spans = {p: (f, 0, 1 << 32) if s is None or e is None else (f, s, e) for p, f, s, e in code}
    want = set()
    for a, fa, _ in rules:
        for b, fb, _ in rules:
            s = len(words[a] & words[b]) / len(words[a] | words[b])
            (x, lo, hi), (y, low, high) = spans[a], spans[b]
            if a < b and fa != fb and (s >= 0.75 or s >= 0.5 and x == y and lo <= high and low <= hi):
                want.add((a, b))
    assert {(p["a"], p["b"]) for p in out.collect()} == want and len(want) > 30
    assert "__b" not in out._jdf.queryExecution().optimizedPlan().toString()  # no meeting of all rules that cite a file


def plain_reach(links, depth):
    members, groups = {}, {}
    for i, g in links:
        if i is not None and g is not None:
            members.setdefault(g, set()).add(i)
            groups.setdefault(i, set()).add(g)
    out = {}
    for i in groups:
        near = {i}
        for _ in range(depth):
            near = {k for j in near for g in groups[j] for k in members[g]}
        if len(near) > 1:
            out[i] = len(near) - 1
    return out


@pytest.mark.parametrize(("depth", "block", "together"), [(1, 4096, 1 << 18), (2, 512, 250), (3, 1024, 1 << 18)])
def test_reach_over_blocks_and_chunks_equals_a_plain_walk(spark, depth, block, together):
    r = random.Random(depth)
    links = [(r.randrange(-700, 900), r.choice([f"g{r.randrange(900)}", f"h{r.randrange(300)}"])) for _ in range(2200)]
    links += links[:300] + [(None, "g1"), (5, None), (None, None), (7000, "alone"), (1 << 40, "g2")] + [(i, "busy") for i in range(2000, 2600)] + [(2001, "g3")]
    df = spark.createDataFrame(links, "id bigint, grp string").repartition(3)
    want = plain_reach(links, depth)
    assert len(set(want.values())) > 10
    got = reach.reach_counts(df, depth, block, together).collect()
    assert {x["start"]: x["reached"] for x in got} == want and len(got) == len(want)
    if depth == 1:
        assert reach.reach_counts(df.limit(0), depth).count() == 0


def test_reach_keeps_no_pairs(spark, tmp_path, monkeypatch):
    kept = type(df := spark.range(1)).checkpoint

    def counted(self, *a, **b):
        out = kept(self, *a, **b)
        assert out.count() < 20_000  # the pairs are 160,000
        return out

    monkeypatch.setattr(type(df), "checkpoint", counted)
    links = [(i, 0) for i in range(400)] + [(i, i) for i in range(399, 410)] + [(i, i + 1) for i in range(399, 410)]
    spark.createDataFrame(links, "l_suppkey int, l_partkey bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["bounded_reach"](spark, str(tmp_path))
    assert dict(got.dtypes) == {"start": "int", "reached": "bigint"}
    assert {x["start"]: x["reached"] for x in got.collect()} == plain_reach(links, 2)


def test_reach_sends_links_and_not_sets_where_all_members_are_tied(spark):
    spark.conf.set(most := "spark.sql.execution.arrow.maxRecordsPerBatch", 500)  # a chunk takes whole batches
    r = random.Random(5)
    links = [(r.randrange(1500), g) for g in range(2000) for _ in range(10)]
    df = spark.createDataFrame(links, "id bigint, grp bigint")
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).head().totalShuffleWrite()
    before = written()
    try:
        got = reach.reach_counts(df, 2, 512, 1000).collect()
    finally:
        spark.conf.unset(most)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert {x["start"]: x["reached"] for x in got} == plain_reach(links, 2) and len(got) == 1500
    assert written() - before < 2_000_000  # 7.7 MB where sets go to chunks and back, 0.4 MB where only links do


def test_reach_in_bounded_memory_equals_a_plain_walk(spark):
    r, rows = random.Random(6), []
    links = sorted({(g, r.randrange(g // 100 * 300, g // 100 * 300 + 500)) for g in range(400) for _ in range(r.randrange(1, 7))})
    dealt = spark.createDataFrame(links, "grp bigint, id bigint").repartitionByRange(12, "grp").sortWithinPartitions("grp", "id")
    chunks = [c.asDict() for c in dealt.mapInArrow(reach._chunked(1 << 18), reach._CHUNK).collect()]
    starts = sorted({int(i) for c in chunks for i in reach._ids(c["low"], c["gaps"])})
    for k in range(0, len(starts), 300):
        rows += [{"ids": starts[k : k + 300]}, *chunks]
    fields = pa.schema([("ids", pa.list_(pa.int64())), ("low", pa.int64()), ("gaps", pa.binary()), ("local", pa.binary()), ("sizes", pa.binary())])
    batches = pa.Table.from_pylist(rows, schema=fields).to_batches(max_chunksize=4)
    got = [x for b in reach._walked(2, 1, 1, 500)(iter(batches)) for x in b.to_pylist()]  # a word of starts at once, most chunks in a file
    assert {x["id"]: x["n"] - 1 for x in got} == plain_reach([(i, g) for g, i in links], 2) and len(got) == len(starts) > 400 and len(chunks) > 8
