"""Neighbouring stretches that the same texts name are sorted as one piece; every repeat is still found."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import zstandard

from lexforge.llm import substrings
from test_unlike_pieces import pieces


def _noise(r: random.Random, n: int) -> bytes:
    return bytes(r.randrange(97, 123) for _ in range(n))


def test_neighbours_are_cut_out_as_one_piece():
    text = _noise(random.Random(1), 900)
    wanted = [{"anchor": a, "several": False, "block": 0, "first": f, "windows": w} for a, f, w in ((7, 90, 60), (7, 0, 90), (8, 150, 50), (7, 200, 30), (7, 260, 20))]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("several", pa.bool_()), ("block", pa.int32()), ("first", pa.int32()), ("windows", pa.int32())]))
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0], pa.int32()), pa.array([1, 2]), pa.array([zstandard.compress(text)] * 2, pa.binary()), pa.array([wanted, None], kind)], names=["k", "mark", "own", "text", "wanted"])
    out = pa.Table.from_batches(substrings._cut_out(200)(iter([rows]))).to_pylist()
    got = sorted((x["first"], x["anchor"], x["windows"], x["bytes"]) for x in out)
    assert got == [(f, a, w, text[f : f + w + 199]) for f, a, w in ((0, 7, 150), (150, 8, 50), (200, 7, 30), (260, 7, 20))]


def test_a_long_piece_sorts_only_what_may_repeat(monkeypatch):
    r = random.Random(2)
    shared, longer = _noise(r, 700), _noise(r, 450)
    texts = [_noise(r, 900) + shared + _noise(r, 900), _noise(r, 50) + shared + longer + _noise(r, 300), longer[40:] + _noise(r, 1200)]
    sorted_bytes, plain = [], substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda text, *a: sorted_bytes.append(len(text)) or plain(text, *a))
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    cols = [[5] * 3, [False] * 3, [0] * 3, [0, 1, 2], [0] * 3, [0] * 3, [len(t) - 199 for t in texts], [False] * 3, texts]
    rows = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in substrings._PIECE.split(", ")])
    out = pa.Table.from_batches(substrings._resolved(200, 96, 1 << 20)(iter([rows]))).to_pylist()
    got = {(x["k"], x["first"] + j) for x in out if x["bytes"] is None for j in range(x["windows"])}
    every = [(i, j, t[j : j + 200]) for i, t in enumerate(texts) for j in range(len(t) - 199)]
    times = {}
    for _, _, w in every:
        times[w] = times.get(w, 0) + 1
    assert got == {(i, j) for i, j, w in every if times[w] > 1} and got
    assert sum(sorted_bytes) < 0.75 * sum(map(len, texts))


def test_nothing_that_may_repeat():
    r = random.Random(3)
    core = _noise(r, 150)
    rows = pieces([_noise(r, 120) + core + _noise(r, 120) for _ in range(3)], False)
    out = pa.Table.from_batches(substrings._resolved(200, 96, 1 << 20)(iter([rows])))
    assert out.num_rows == 0


def test_longer_texts_are_as_brute_force(spark):
    r = random.Random(4)
    shared = [_noise(r, n).decode() for n in (3000, 260, 199, 900)]
    texts = [shared[0] + shared[1], _noise(r, 700).decode() + shared[0], shared[3] + shared[2] + shared[3], shared[2] + shared[0][500:1800] + shared[1], shared[0] + shared[1], "ab" * 900, None, "x"]
    got = {x["doc_id"]: x for x in substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    whole = [(t or "").encode() for t in texts]
    times = {}
    for t in whole:
        for j in range(len(t) - 199):
            times[t[j : j + 200]] = times.get(t[j : j + 200], 0) + 1
    for i, t in enumerate(whole):
        gone = np.zeros(len(t), bool)
        for j in range(len(t) - 199):
            if times[t[j : j + 200]] > 1:
                gone[j : j + 200] = True
        assert bytes(got[i]["kept"]) == bytes(np.frombuffer(t, np.uint8)[~gone])
        assert got[i]["n_removed"] == gone.sum()
