"""Queries and operators do their whole job: no caps, subsets or cuts; each held against plain Python."""

from __future__ import annotations

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

from lexforge import catalog
from lexforge.operators import graphs, ranking, retrieval

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def fit(rows, budget):
    used, docs = 0, []
    for _, doc, cost in sorted(rows):
        if used + cost <= budget:
            used += cost
            docs.append(doc)
    return used, docs


def test_greedy_fit_equals_a_plain_fold(spark):
    r = random.Random(4)
    rows = [(q, i, 1000 * q + i, r.choice([0, 2, 3, 5, 40, 90, 99, 100, 101, 300]) if q else 200) for q in range(4) for i in range(400)]
    hits = spark.createDataFrame(rows, "q int, rank int, doc bigint, cost int")
    got = {x["q"]: (x["used"], x["docs"]) for x in retrieval.greedy_fit(hits, ["q"], [F.col("rank")], F.col("cost"), 100).collect()}
    assert got == {q: fit([x[1:] for x in rows if x[0] == q], 100) for q in range(4)}


def test_evidence_fit_reads_past_the_best_forty(spark, tmp_path):
    d = str(tmp_path)
    # Long documents hold the word more often and come first; only the last, a short one, fits the budget that they leave.
    texts = [(i, "zebra " * 150) for i in range(60)] + [(60, "zebra " + "quince " * 50), (61, "zebra once in a text")]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "zebra")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    index = retrieval.build(spark.createDataFrame(texts, "doc_id bigint, text string"), "doc_id", "text")
    ranks = retrieval.search(index, spark.createDataFrame([(1, "zebra")], "item_id bigint, text string"), "item_id", "text", "any", None).collect()
    sizes = dict(texts)
    want = fit([(x["rank"], x["doc"], min(len(sizes[x["doc"]]), 400) + 3) for x in ranks], 1200)
    assert {x["doc"]: x["rank"] for x in ranks}[61] > 40 and 61 in want[1]
    r = catalog.QUERIES["evidence_fit"](spark, d).first()
    assert (r["used"], r["docs"]) == want


def test_global_rank_equals_sorting(spark):
    r = random.Random(5)
    rows = [(i, r.choice([None, 0.1, 0.5, 0.9])) for i in range(700)]
    df = spark.createDataFrame(rows, "id int, c double").repartition(5)
    got = {x["id"]: x["rank"] for x in ranking.global_rank(df, [F.desc_nulls_last("c"), F.col("id")]).collect()}
    assert got == {i: n + 1 for n, (i, _) in enumerate(sorted(rows, key=lambda x: (x[1] is None, -(x[1] or 0), x[0])))}
    assert ranking.global_rank(df.limit(0), [F.col("id")]).count() == 0


@pytest.mark.parametrize("name", ["priority_order", "undocumented_order"])
@tables
def test_orders_are_ranked_whole(spark, name):
    n = spark.read.parquet(f"{DIR}/orders.parquet").count()
    place = "rank" if name.startswith("priority") else "place"
    got = sorted(x[place] for x in catalog.QUERIES[name](spark, DIR).collect())
    assert got == list(range(1, n + 1)) and n > 200
    assert "qualify" not in catalog.ORACLE_SQL[name] and "limit" not in catalog.ORACLE_SQL[name]


@tables
def test_actors_resolve_among_all_names(spark):
    rows = catalog.QUERIES["actor_resolution"](spark, DIR).collect()
    known = dict(spark.read.parquet(f"{DIR}/customer.parquet").select("c_custkey", "c_name").collect())
    assert {x["id"]: x["resolved"] for x in rows} == {k: None if k % 3 == 2 else n for k, n in known.items()}


def test_actors_past_the_first_five_hundred_resolve(spark, tmp_path):
    spark.createDataFrame([(k, f"Customer#{k:09d}") for k in range(480, 640)], "c_custkey bigint, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    got = {x["id"]: x["resolved"] for x in catalog.QUERIES["actor_resolution"](spark, str(tmp_path)).collect()}
    assert got == {k: None if k % 3 == 2 else f"Customer#{k:09d}" for k in range(480, 640)}
    assert "500" not in catalog.ORACLE_SQL["actor_resolution"]


def plain_slice(mentions, owners, start, depth, most):
    """The reference's walk: names of at most six files, the two nearest that aren't seen, best ranks first."""
    seen, frontier, out = {start}, [start], []
    for hop in range(1, depth + 1):
        best = {}
        for src in frontier:
            scores = collections.Counter()
            for key, n in mentions.get(src, {}).items():
                files = owners.get(key, set())
                if len(files) <= 6:
                    near = sorted(files - seen - {src}, key=lambda f: (-len(os.path.commonprefix([src.split("/"), f.split("/")])), f.count("/"), f))
                    for f in near[:2]:
                        scores[f] += n
            for rank, f in enumerate(sorted(scores, key=lambda f: (-scores[f], f)), 1):
                best[f] = min(rank, best.get(f, rank))
        frontier = sorted(best, key=lambda f: (best[f], f))[: most - len(out)]
        out += [(f, hop) for f in frontier]
        seen |= set(frontier)
        if len(out) >= most:
            break
    return out


@pytest.mark.parametrize("most", [3, 8, 1000])
def test_slices_equal_the_plain_walk(spark, most):
    r = random.Random(6)
    files = [f"{r.choice('ab')}/{'x/' * r.randrange(3)}f{i}" for i in range(40)]
    mentions = {f: {f"k{k}": r.randrange(1, 5) for k in r.sample(range(30), 4)} for f in files}
    owners = {f"k{k}": set(r.sample(files, r.choice([1, 2, 3, 5, 6, 7]))) for k in range(30)}
    m = spark.createDataFrame([(f, k, n) for f, ks in mentions.items() for k, n in ks.items()], "src string, key string, n int")
    o = spark.createDataFrame([(k, f) for k, fs in owners.items() for f in fs], "key string, dst string")
    got = graphs.named_slice(m, o, spark.createDataFrame([(f,) for f in files], "start string"), 2, most).collect()
    want = {(f, n, hop, place) for f in files for place, (n, hop) in enumerate(plain_slice(mentions, owners, f, 2, most), 1)}
    assert {(x["start"], x["node"], x["hop"], x["place"]) for x in got} == want and any(x[2] == 2 for x in want)


def test_slice_reach_starts_from_all_files_and_knows_all_owners(spark, tmp_path):
    texts = [(1, "alpha shared", "src2"), (2, "alpha other", "src2"), (3, "alpha third", "src3"), (4, "other lonely", "src3")]
    spark.createDataFrame([(i, t, s, "en") for i, t, s in texts], "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(x["start"], x["node"], x["hop"]) for x in catalog.QUERIES["slice_reach"](spark, str(tmp_path)).collect()}
    name = {i: f"src/{s}/en/d{i}" for i, _, s in texts}
    assert got == {(name[a], name[b], h) for a, b, h in [(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 1, 1), (2, 3, 1), (2, 4, 1), (3, 1, 1), (3, 2, 1), (3, 4, 2), (4, 2, 1), (4, 1, 2), (4, 3, 2)]}


def test_reach_takes_all_rows_and_two_hops(spark, tmp_path):
    rows = [(1, 10, 1), (2, 10, 1), (2, 11, 50), (3, 11, 50), (3, 12, 2), (4, 12, 2), (5, 13, 9)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_quantity int").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {x["start"]: x["reached"] for x in catalog.QUERIES["bounded_reach"](spark, str(tmp_path)).collect()}
    assert got == {1: 2, 2: 3, 3: 3, 4: 2}


def test_part_markers_keep_whole_texts(spark, tmp_path):
    texts = [(1, "(part 1/2) " + "long " * 40), (2, " line\n" * 30), (3, None)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {x["doc_id"]: x["plain"] for x in catalog.QUERIES["part_markers"](spark, str(tmp_path)).collect()} == dict(texts)
