"""Items of hundreds of words near the edit limit, against plain edit distance."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lexforge.llm import decontaminate
from lexforge.llm.bytesview import chunks as byte_chunks

SIZES = (59, 60, 61, 62, 200, 300, 500, 1000)


def plain(item, text):
    """Least edits of the item against any run of the text."""
    words = {w: i for i, w in enumerate({*item, *text})}
    t, at = np.array([words[w] for w in text]), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, np.int64)
    for i, w in enumerate(item):
        new = np.append(i + 1, np.minimum(row[:-1] + (t != words[w]), row[1:] + 1))
        row = np.minimum.accumulate(new - at) + at
    return int(row.min())


def edited(r, words, n, fresh):
    w = list(words)
    for _ in range(n):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [r.choice(fresh)], [w[i], r.choice(fresh)]])
    return w


def corpus(seed=11, each=2):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    items = [(10 * n + j, r.choices(vocabulary, k=n)) for n in SIZES for j in range(each)]
    texts = []
    for _, w in items:
        for share in (0, 0.15, 0.2, 0.3):
            texts.append(r.choices(vocabulary, k=r.randrange(400)) + edited(r, w, int(len(w) * share + 1e-9), vocabulary) + r.choices(vocabulary, k=r.randrange(400)))
    texts.append([w for _ in range(3) for w in edited(r, items[-1][1], 200, vocabulary)])  # one item, three times
    texts += [items[-1][1][100:], items[-1][1][:-250], [], r.choices(vocabulary, k=3000)]
    return items, texts


def found(items, texts, exact_only=False):
    block = decontaminate.prepare([(i, " ".join(w)) for i, w in items])
    got = set()
    for c in byte_chunks(pa.array([" ".join(t) for t in texts], pa.string())):
        d, k, e = decontaminate.find(*decontaminate.word_hashes(c), block, exact_only)
        got |= {(c.lo + int(a), block.ids[int(b)], int(x)) for a, b, x in zip(d, k, e, strict=True)}
    return got


def test_long_items_are_found_up_to_the_edit_limit():
    items, texts = corpus()
    want = {(d, i, e) for d, t in enumerate(texts) for i, w in items if len(w) > 60 and (e := plain(w, t)) <= len(w) // 5}
    got = {x for x in found(items, texts) if x[1] >= 610}
    assert got == want and len(want) >= 36


def test_long_and_short_items_in_one_block():
    items, texts = corpus(seed=12, each=1)
    assert {x for x in found(items, texts) if x[2] == 0} >= {(4 * i, item, 0) for i, (item, _) in enumerate(items)}


def test_long_items_alone_and_one_by_one(monkeypatch):
    items, texts = corpus(seed=13, each=1)
    longs = [x for x in items if len(x[1]) > 60]
    want = {x for x in found(items, texts) if x[1] >= 610}
    assert found(longs, texts) == want
    monkeypatch.setattr(decontaminate, "REGION_WORDS", 1)
    assert found(longs, texts) == want
