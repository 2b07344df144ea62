"""Stretches that share an anchor but can have no window in common aren't sorted; every repeat is still found."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lexforge.llm import bytesview as bv
from lexforge.llm import substrings


def pieces(texts: list[bytes], several: bool) -> pa.RecordBatch:
    """All stretches of the texts, in blocks by anchor."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    c = bv.Chunk(0, len(texts), buf, np.cumsum([0, *map(len, texts)]))
    anchor, doc, first, windows, _ = substrings.stretches(c)
    rows = sorted(zip(anchor.view(np.int64).tolist(), doc.tolist(), (first - c.offs[doc]).tolist(), windows.tolist(), strict=True))
    cols = [[a for a, *_ in rows], [several] * len(rows), [0] * len(rows), [d for _, d, *_ in rows], [0] * len(rows), [f for *_, f, _ in rows], [w for *_, w in rows], [False] * len(rows), [texts[d][f : f + w + 199] for _, d, f, w in rows]]
    types = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=[x.split()[0] for x in substrings._PIECE.split(", ")])


@pytest.mark.parametrize("several", [False, True])
def test_repeats_are_those_of_brute_force(several, monkeypatch):
    r = random.Random(several)
    noise = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    core = noise(150)
    texts = [noise(120) + core + noise(120) for _ in range(6)]  # all share 150 bytes, none 200
    long = noise(230)
    texts += [noise(70) + long + noise(40), long, noise(3) + long[:200], noise(9) + long[31:], b"ab" * 160, b"a" * 205 + noise(60), noise(20) + b"ab" * 101, long[5:204]]
    sorted_bytes, plain = [], substrings.repeated_windows
    monkeypatch.setattr(substrings, "repeated_windows", lambda text, *a: sorted_bytes.append(len(text)) or plain(text, *a))
    rows = pieces(texts, several)
    out = pa.Table.from_batches(substrings._resolved(200, 96, 1 << 20)(iter([rows]))).to_pylist()
    got = {(x["k"], x["first"] + j) for x in out if x["bytes"] is None for j in range(x["windows"])}
    every = [(i, j, t[j : j + 200]) for i, t in enumerate(texts) for j in range(len(t) - 199)]
    times = {}
    for _, _, w in every:
        times[w] = times.get(w, 0) + 1
    assert got == {(i, j) for i, j, w in every if times[w] > 1}
    passed_on = {x["bytes"][j : j + 200] for x in out if x["bytes"] is not None for j in range(x["windows"])}
    assert passed_on == (set(times) if several else set())
    assert sum(sorted_bytes) < sum(map(len, rows.column("bytes").to_pylist())) / 2
