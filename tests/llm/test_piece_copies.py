"""Copies of a stretch: two are sorted, further ones take the first's result, by bytes and not by hash."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lexforge.llm import bytesview as bv
from lexforge.llm import substrings


def test_two_copies_are_sorted_for_all(monkeypatch):
    r = random.Random(3)
    base = [bytes(r.randrange(97, 101) for _ in range(260)) for _ in range(5)]
    texts = [base[0]] * 20 + [base[1]] * 3 + [base[2], base[3] + base[4][:20], b"x" + base[3][:240]]
    r.shuffle(texts)
    sizes, plain = [], substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda text, *a: sizes.append(len(text)) or plain(text, *a))
    n = len(texts)
    rows = pa.RecordBatch.from_arrays([pa.array([7] * n), pa.array([False] * n), pa.array([0] * n, pa.int32()), pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array([5] * n, pa.int32()), pa.array([len(t) - 199 for t in texts], pa.int32()), pa.array([i == texts.index(base[0]) for i in range(n)]), pa.array(texts, pa.binary())], names=[x.split()[0] for x in substrings._PIECE.split(", ")])
    monkeypatch.setattr(substrings, "SORTED", 100, raising=False)
    out = pa.Table.from_batches(substrings._resolved(200, 96, 1 << 20)(iter([rows]))).to_pylist()
    got = {(x["k"], x["first"] - 5 + j) for x in out if x["bytes"] is None for j in range(x["windows"])}
    every = [(i, j, t[j : j + 200]) for i, t in enumerate(texts) for j in range(len(t) - 199)]
    times = {}
    for _, _, w in every:
        times[w] = times.get(w, 0) + 1
    assert got == {(i, j) for i, j, w in every if times[w] > 1 and i != texts.index(base[0])}
    assert max(sizes) < 8 * 290


def test_pieces_of_one_hash_are_compared(monkeypatch):
    monkeypatch.setattr(bv.Hasher, "of", lambda self, a, b: np.zeros(len(a), np.uint64))
    texts = [b"a" * 203, b"a" * 203, b"a" * 202 + b"b", b"a" * 203, b"a" * 203, b"a" * 204]
    first, nth = substrings.copies(np.array([0, 0, 0, 0, 1, 1]), np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    assert first.tolist() == [0, 0, 2, 0, 4, 5] and nth.tolist() == [0, 1, 0, 2, 0, 0]
