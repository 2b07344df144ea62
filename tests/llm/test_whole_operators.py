"""Whole operators against plain Python, exact comparison or held-out labels."""

from __future__ import annotations

import hashlib
import os
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from lexforge.llm import bpe, decontaminate, langid, quality, queries_tokens, registry
from lexforge.llm.bytesview import chunks as byte_chunks

DIR = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


def sentence(r, n=9):
    return " ".join("".join(r.choices("abcdeghilmnorstu", k=r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def junk(r):
    return r.choice(["a | b | c | d", "*** %%% ### $$$ &&&", "CLICK HERE!!! BUY NOW!!!", "Home | Login | Terms | More"]) + f" {r.randrange(99)}"


def corpus(seed, n=60):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        clean = [sentence(r) for _ in range(r.randrange(6, 20))]
        bad = [junk(r) for _ in range(r.randrange(20, 40))]
        rows.append((i, "\n".join(clean if i % 2 else bad + clean[:3]), i % 2))
    return rows


def plain_share(text, emit, move):
    """Words in content lines by the best of all label sequences, line by line."""
    x = quality.Lines(next(byte_chunks(pa.array([text], pa.string()))))
    score = x.features @ emit
    best, back = [score[0].tolist()], []
    for s in score[1:]:
        step = [[best[-1][a] + move[a][b] for a in (0, 1)] for b in (0, 1)]
        back.append([int(c[1] > c[0]) for c in step])
        best.append([s[b] + max(step[b]) for b in (0, 1)])
    label = int(best[-1][1] > best[-1][0])
    labels = [label]
    for b in reversed(back):
        label = b[label]
        labels.append(label)
    return sum(int(w) for w, y in zip(x.words, reversed(labels), strict=True) if y == 0), int(x.words.sum())


def test_quality_verdicts_equal_a_plain_decoding(spark):
    train, held = corpus(1), corpus(2)
    weights = quality.fit([t for _, t, _ in train], [bool(q) for _, _, q in train])
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame([x[:2] for x in held], "doc_id bigint, text string"), weights).collect()}
    for i, text, good in held:
        content, words = plain_share(text, *weights)
        assert got[i]["content_words"] == content and got[i]["kept"] == (not got[i]["base_failed"] and content >= 0.5 * words)
        assert got[i]["kept"] == bool(good)


@tables
def test_held_out_languages(spark):
    rows = registry.QUERIES["op8_language"](spark, DIR).join(spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)


def test_decontamination_recall_of_the_whole_operator(spark):
    r = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, r.choices(vocabulary, k=n)) for i, n in enumerate([1, 3, 4, 5, 9, 10, 14, 20, 25, 30, 40, 59, 60, 61, 90, 150, 400, 2000])]
    texts = []
    for _ in range(3):
        for _, w in items:
            w = list(w)
            for _ in range(r.randrange(len(w) // 5 + 1)):
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice(vocabulary)], [w[k], r.choice(vocabulary)]])
            texts.append(" ".join(r.choices(vocabulary, k=r.randrange(30)) + w + r.choices(vocabulary, k=r.randrange(30))))
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string")
    table = spark.createDataFrame([(f"i{i}", " ".join(w)) for i, w in items], "item_id string, text string")
    want, got = ({tuple(x) for x in decontaminate.matches(docs, table, exact_only=e).collect()} for e in (True, False))
    pairs = {x[:2] for x in want}
    assert {x[:2] for x in got} <= pairs and len({x[:2] for x in got}) >= 0.95 * len(pairs) and len(got & want) >= 0.9 * len(want)


def test_very_long_items_take_little_memory():
    items = decontaminate.prepare([(i, " ".join(f"x{i}y{k}" for k in range(20))) for i in range(300)] + [(900, " ".join(f"z{k}" for k in range(20_000)))])
    assert items.segments.nbytes < 1 << 20 and items.has.nbytes < 8 << 20


def test_pipeline_of_planted_documents(spark, tmp_path):
    d = str(tmp_path)
    r = random.Random(9)
    clean = [" ".join(sentence(r) for _ in range(8)) + "\n" + " ".join(sentence(r) for _ in range(8)) for _ in range(8)]
    passage = " ".join(sentence(r) for _ in range(3))
    token = hashlib.sha1(b"x").hexdigest()
    texts = {
        1: clean[0], 2: clean[0], 3: clean[0].replace(clean[0].split()[40], "changed"), 4: clean[1], 5: clean[2] + "\n" + passage, 6: clean[3] + f'\nset token = "{token}" here',
        7: "\n".join(junk(r) for _ in range(60)), 8: "too short", 9: None, 10: clean[4],
    }
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in texts.items()], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in (7, 8)), 0) for i in texts], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    want = {1: texts[1], 4: texts[4], 6: texts[6].replace(token, "[SECRET]"), 10: texts[10]}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(queries_tokens.vocabulary()), special_tokens={})
    got = {x["doc_id"]: (x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in corpus_pipeline.run(spark, d).collect()}
    for i, t in want.items():
        ids = enc.encode_ordinary(t)
        assert got.pop(i) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    assert not got


def test_no_language_without_labels():
    assert langid.train([], []) is None
