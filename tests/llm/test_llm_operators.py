"""Whole operators on small tables: against brute force, and the cases that each docstring defines."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from lexforge.llm import bpe, decontaminate, langid, licenses, near, quality, queries_tokens, registry, secrets, sharding, substrings, warc

DDL = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, part int, bands string"
LONG = " ".join(f"word{i * 7919 % 1013}" for i in range(9000))
PASSAGE = " ".join(f"shared{i}" for i in range(70))


@pytest.fixture(scope="module")
def docs(spark):
    near_copy = " ".join("changed" if i == 40 else w for i, w in enumerate(LONG.split()[:120]))
    texts = [None, "", "   ", "one", "a b c", "a b c", LONG, LONG, " ".join(LONG.split()[:120]), near_copy, "x" * 3000, "aba " * 400, f"first {PASSAGE} and more", f"second thing {PASSAGE}", "café 漢字 \U0001f600 it's 12 34", 'key token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" here', "Licensed under CC BY-NC 4.0."]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"src{i}", len(t or ""), "x", i, "y") for i, t in enumerate(texts)]
    rows += [rows[8], (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def thue_morse(rounds):
    """Two strings that agree under every polynomial hash modulo a power of two."""
    a, b = "a", "b"
    for _ in range(rounds):
        a, b = a + b, b + a
    return a, b


def test_structured_words_stay_apart(spark):
    a, b = thue_morse(11)
    rows = spark.createDataFrame([(1, f"{a} {b}"), (2, f"{b} {a} {a}"), (3, f"{a}\n{b}\n{a}")], "doc_id bigint, text string")
    path = queries_tokens.vocabulary()
    for batch in (1, 1 << 20):
        got = bpe.decode(bpe.encode(rows, path, batch_bytes=batch, bucket_bytes=5000 * batch), path).collect()
        assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in got} == {1: f"{a} {b}", 2: f"{b} {a} {a}", 3: f"{a}\n{b}\n{a}"}
    weights = (np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.judge(rows, weights).collect()} == {1: 0, 2: 0, 3: 1}
    assert {r["n_links"] for r in near.jaccard_join(rows).collect()} == {0}
    cut = {r["doc_id"]: tuple(r)[1:4] for r in substrings.remove_repeats(rows).collect()}
    assert cut == {i + 1: x[:3] for i, x in enumerate(brute_repeats([r["text"].encode() for r in rows.orderBy("doc_id").collect()], 200))}


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe.bv.Hasher, "of", lambda self, s, e: np.zeros(len(s), np.uint64))
    buf = np.frombuffer(b"onetwotwoone", np.uint8)
    numbers, data, offs = bpe.distinct_strings([(buf, np.array([0, 3, 6, 9]), np.array([3, 6, 9, 12]))])
    assert numbers[0].tolist() == [0, 1, 1, 0] and data.tobytes() == b"onetwo" and offs.tolist() == [0, 3, 6]


def test_decoding_of_any_ids(spark):
    path = queries_tokens.vocabulary()
    rows = spark.createDataFrame([(1, np.array([5, 5, 900], "<u4").tobytes()), (2, None), (3, b"")], "doc_id bigint, ids binary")
    by_id = {v: k for k, v in bpe.load_ranks(path).items()}
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, path).collect()}
    assert got == {1: by_id[5] * 2 + by_id[900], 2: None, 3: b""}
    with pytest.raises(Exception, match="no such token"):
        bpe.decode(spark.createDataFrame([(1, b"\xff\xff\xff\x7f")], "doc_id bigint, ids binary"), path).collect()


def test_bpe_equals_the_library(spark, docs, empty):
    path = queries_tokens.vocabulary()
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries_tokens.digest(docs).collect())
    want = collections.Counter()
    for r in docs.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert got == want
    assert queries_tokens.digest(empty).count() == 0


def brute_repeats(texts, length):
    n = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        keep = [True] * len(t)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                keep[i : i + length] = [False] * length
        yield len(t), keep.count(False), sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep)), bytes(b for b, k in zip(t, keep, strict=True) if k)


def removed(rows, **options):
    return collections.Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.remove_repeats(rows, **options).collect())


@pytest.mark.parametrize("block", [2, 32])
def test_repeats_equal_brute_force(docs, empty, block):
    rows = docs.collect()
    want = collections.Counter((r["doc_id"], *x) for r, x in zip(rows, brute_repeats([(r["text"] or "").encode() for r in rows], 200), strict=True))
    assert removed(docs, block=block) == want
    assert substrings.remove_repeats(empty).count() == 0


def test_one_hot_line_in_other_surroundings(spark):
    r = random.Random(4)
    words = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    line, near_copy = words(14), words(90)
    rows = [(f"id{i % 40}", f"{words(r.randrange(40))} {line} {words(r.randrange(40))}") for i in range(60)]
    rows += [(None, near_copy[:i] + "#" + near_copy[i:]) for i in range(0, 600, 40)] + [("same", near_copy)] * 20
    want = collections.Counter((r[0], *x) for r, x in zip(rows, brute_repeats([t.encode() for _, t in rows], 200), strict=True))
    assert removed(spark.createDataFrame(rows, "doc_id string, text string"), block=3) == want


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("block", [2, 256])
def test_jaccard_join_equals_brute_force(spark, docs, empty, block):
    many = spark.createDataFrame([(100 + i, " ".join("edit" if j == 5 * i else f"n{j}" for j in range(200)), "en", "s", 1, "", 1, "") for i in range(9)], DDL)
    both = docs.unionByName(many)
    rows = [r for r in both.collect() if r["doc_id"] is not None]
    first = {}
    for r in rows:
        first[r["text"] or ""] = min(first.get(r["text"] or "", 1 << 60), r["doc_id"])
    sets = {i: shingle_set(t) for t, i in first.items()}
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0}
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    n = collections.Counter(x for p in links for x in p)
    want = collections.Counter((r["doc_id"], first[r["text"] or ""], root[first[r["text"] or ""]], n[first[r["text"] or ""]]) for r in rows)
    got = near.jaccard_join(both, block=block).collect()
    assert collections.Counter(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert [tuple(r) for r in got if r["doc_id"] is None] == [(None, None, None, 0)] * 2
    assert {(r["a"], r["b"]) for r in near.jaccard_pairs(both, block=block).collect()} == links
    assert near.jaccard_join(empty).count() == 0


def test_quality_of_hard_rows(docs, empty):
    w = (np.zeros((quality.N_FEATURES, 2)), np.zeros((2, 2)))
    got = quality.judge(docs, w, carry=("doc_id", "id", "part")).collect()
    assert len(got) == docs.count() and all(r["kept"] != r["base_failed"] for r in got)
    assert quality.judge(empty, w).count() == 0
    assert quality.training_sample(docs, docs.select("doc_id", F.lit(1).alias("quality")).limit(0)) == ([], [])


def test_languages(spark, docs, empty):
    net = langid.train(["the cat and the dog " * 20] * 4, ["en"] * 4, steps=5)
    got = {r["doc_id"]: r for r in langid.predict(docs, net).collect() if r["doc_id"] is not None}
    assert {i for i, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2}
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(empty, net).count() == 0
    texts, langs = langid.training_sample(docs, F.lit(True))
    assert set(langs) == {"en"} and all(texts)


def plain_two_pass(rows, shards, seed, buckets, key):
    """The two passes over a list, with the operator's bucket of each row: place by place."""
    out, place = [], 0
    for b in range(buckets):
        held = sorted((r for r in rows if key[r] == b), key=lambda r: tuple((x is None, x) for x in r))
        for i in sharding.fisher_yates(len(held), seed, b).tolist():
            out.append((*held[i], place % shards, place // shards))
            place += 1
    return out


def test_shards_equal_two_plain_passes(spark, docs, empty):
    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.coalesce("text", F.lit("")).alias("t"))
    keys = ["doc_id", "t", "size"]
    hashed = rows.select(*keys, F.pmod(F.xxhash64(sharding._hash(17, keys), F.lit(0).cast("bigint")), F.lit(3)).alias("b")).collect()
    want = plain_two_pass([tuple(r)[:3] for r in hashed], 3, 17, 3, {tuple(r)[:3]: r["b"] for r in hashed})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (4, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        dealt = sharding.two_pass(rows.repartition(parts), keys, "size", shards=3, bucket_rows=8).collect()
        assert sorted((r["shard"], r["slot"], r["doc_id"] or -1, r["t"]) for r in dealt) == sorted((x[3], x[4], x[0] or -1, x[1]) for x in want)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sharding.two_pass(rows.limit(0), ["doc_id"], "size", shards=3).count() == 0


def test_equal_rows_spread_over_buckets(spark):
    rows = spark.range(400).select(F.when(F.col("id") < 300, F.lit("same")).otherwise(F.col("id").cast("string")).alias("k"), F.lit(1).alias("size"))
    found = sharding._copies(rows, ["k", "size"], "size", 17, 1 << 20, 40).groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("__copy").alias("c")).collect()
    assert {(r["n"], r["c"]) for r in found} == {(300, 300), (1, 1)}
    dealt = sharding.two_pass(rows, ["k", "size"], "size", shards=8, bucket_rows=40).collect()
    assert collections.Counter(r["shard"] for r in dealt) == {s: 50 for s in range(8)}
    assert {(r["shard"], r["slot"]) for r in dealt} == {(s, i) for s in range(8) for i in range(50)}


def test_shards_are_written_in_order(spark, tmp_path):
    rows = spark.range(50).withColumn("size", F.lit(1))
    sharding.write_shards(sharding.two_pass(rows, ["id"], "size", shards=4, bucket_rows=9), str(tmp_path / "s"))
    written = spark.read.parquet(str(tmp_path / "s")).withColumn("file", F.input_file_name()).collect()
    assert len(written) == 50
    for file in {r["file"] for r in written}:
        slots = [r["slot"] for r in written if r["file"] == file]
        assert slots == sorted(slots)


def test_licenses(spark, docs, empty):
    mit = licenses.TEMPLATES["mit"].split()
    rows = [(50, "before " * 40 + " ".join(mit) + " after" * 3), (51, " ".join(mit[:20])), (52, "RELEASED under the (MIT) license"), (53, "licensed"), (54, None)]
    got = {tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {(50, "mit", 1.0), (52, "mit-line", 1.0)}
    assert [r["license"] for r in licenses.scan(docs).collect()] == ["cc-by-nc-4.0-line"]
    line = "Released under the MIT License."
    again = spark.createDataFrame([(1, line), (1, line), (None, line), (None, f"x {line}")], "doc_id bigint, text string")
    assert collections.Counter(r["doc_id"] for r in licenses.scan(again).collect()) == {1: 2, None: 2}
    assert licenses.scan(empty).count() == 0


def test_secrets_and_masks(docs, empty):
    got = secrets.scan(docs).collect()
    assert [(r["doc_id"], r["secret"]) for r in got] == [(15, "24be64439e3e49cf46b2d7c90f3602a3d0b907ff")]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect() if r["doc_id"] is not None}
    assert masked[15] == 'key token = "[SECRET]" here' and masked[6] == LONG and masked[0] is None
    assert secrets.redact(docs).columns == docs.columns and secrets.scan(empty).count() == 0
    named = docs.withColumn("words", F.lit("mine")).withColumn("__words", F.lit("too")).withColumnRenamed("n_chars", "found")
    assert {(r["words"], r["__words"]) for r in secrets.redact(named).collect()} == {("mine", "too")}


def test_column_features_equal_python(spark):
    found = secrets.labelled_findings(300, seed=8)
    df = spark.createDataFrame(found, "c string, b string, p string, a string, y int")
    cols = [f.alias(n) for f, n in zip(secrets.features(F.col("c"), F.col("b"), F.col("p"), F.col("a")), secrets.NAMES, strict=True)]
    for r in df.select("*", *cols).collect():
        assert [r[n] for n in secrets.NAMES] == secrets.features_py(r["c"], r["b"], r["p"], r["a"])


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, PASSAGE), (2, None), (3, ""), (1, PASSAGE)], "item_id bigint, text string")
    got = {tuple(r) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(12, 1, 0, 70), (13, 1, 0, 70)}
    for size in (1, 1 << 20):
        kept = decontaminate.clean(docs, items, item_bytes=size)
        assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert decontaminate.matches(docs, items.limit(0)).count() == 0 and decontaminate.matches(empty, items).count() == 0


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<html lang=en><title>T &amp; x</title><script>no</script><p>Hi<b>!</b><br>you &lt;3</html>"), (2, None, None)], "page_id bigint, url string, html string")
    rows = warc.derivatives(warc.responses(pages))
    by = {(r["page_id"], r["warc_type"]): r for r in rows.collect()}
    assert by[1, "conversion"]["block"] == "Hi!\nyou <3" and by[2, "conversion"]["block"] == ""
    assert "title: T & x\r\nlanguage: en\r\noutlinkCount: 0" in by[1, "metadata"]["block"]
    assert by[1, "conversion"]["refers_to"] == by[1, "metadata"]["refers_to"] != by[1, "conversion"]["record_id"]
    assert warc.write_warc(rows, str(tmp_path / "w")) == 4
    assert {r["record_id"] for r in warc.read_warc(spark, str(tmp_path / "w")).collect()} == {r["record_id"] for r in by.values()}
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_near_duplicate_stage_tells_rows_of_one_id_apart(spark):
    near_copy = " ".join("changed" if i == 40 else w for i, w in enumerate(LONG.split()[:120]))
    a = " ".join(LONG.split()[:120])
    rows = [(1, a), (5, near_copy), (5, PASSAGE), (5, PASSAGE), (None, "words of its own here"), (None, a), (None, None)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row string")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted([(1, a), (5, PASSAGE), (None, "words of its own here"), (None, None)], key=str)


def test_pipeline_stages(spark, docs, empty, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, PASSAGE)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [f for _, f in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5
    for start in (docs, empty):
        rows = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, rows, d)
            assert out.columns == docs.columns, name
            out.write.mode("overwrite").parquet(f"{d}/{name}-{start is docs}")
            rows = spark.read.parquet(f"{d}/{name}-{start is docs}")
        left = {r["doc_id"] for r in rows.collect()}
        assert left == ({8} if start is docs else set())  # the long one repeats itself
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, d).collect()} == {8}


def test_registry_names_ten_operators_and_the_pipeline():
    assert {re.match(r"op(\d+)_|pipeline", n)[0] for n in registry.QUERIES} == {"pipeline", *(f"op{i}_" for i in range(1, 11))}
    assert zlib.crc32(b"1") == 2212294583
