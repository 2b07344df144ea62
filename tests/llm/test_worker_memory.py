"""Python workers give freed memory back when a function ends: they wait for further tasks and would keep it."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pytest

from lexforge.llm import bpe, queries_tokens, shared


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * 4096


@pytest.mark.skipif(not Path("/proc/self/statm").exists(), reason="no /proc")
def test_freed_memory_is_given_back():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [bytes(2000) for _ in range(50_000)]
        kept.append(held[-1])  # keeps the heap's end in use
        yield from batches

    kept = []
    before = resident()
    assert list(shared.gives_back(run)(iter([1, 2]))) == [1, 2]
    assert resident() - before < 40 << 20


def test_results_and_errors_pass_through(monkeypatch):
    calls = []
    monkeypatch.setattr(shared, "release", lambda: calls.append(1))
    assert shared.gives_back(lambda a, b: a + b)(1, 2) == 3

    def fails(batches):
        yield 1
        raise ValueError

    with pytest.raises(ValueError):
        list(shared.gives_back(fails)(()))
    assert len(calls) == 2


def test_encoding_and_decoding_release(spark, monkeypatch):
    asked, plain = [], shared.gives_back
    monkeypatch.setattr(bpe, "gives_back", lambda f: asked.append(f.__qualname__.split(".")[0]) or plain(f), raising=False)
    docs = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id bigint, text string")
    assert [r.n_tokens for r in queries_tokens.digest(docs).orderBy("doc_id").collect()] == [3, 0]
    assert asked == ["_exploded", "_asked", "_merged", "_assembled", "decode"]
