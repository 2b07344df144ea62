"""Byte-level kernels against plain Python."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex

from lexforge.llm import bpe, decontaminate, langid, licenses, near, quality, secrets, sharding
from lexforge.llm import bytesview as bv
from lexforge.llm.lyndon import suffix_arrays

TEXTS = ["", None, "one", "a b c d e f g", "a b c d e", "x " * 30, "  lead\n\ntrail  ", "é ü 漢字 😀 a\tb", "same line\nsame line\n \n#*$ x", "w" * 5000, "Und " * 400]


def chunked(texts, limit):
    for c in bv.chunks(pa.array(texts, pa.string()), limit):
        yield c


@pytest.mark.parametrize("limit", [7, 100, 1 << 20])
def test_words(limit):
    for c in chunked(TEXTS, limit):
        s, e, first = bv.words(c)
        for i in range(c.hi - c.lo):
            got = [bytes(c.buf[a:b]).decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)]
            assert got == re.findall("[^\x20\x09-\x0d]+", TEXTS[c.lo + i] or "")


@pytest.mark.parametrize("limit", [11, 1 << 20])
def test_grams_are_sets_of_word_runs(limit):
    seen = {}
    for c in chunked(TEXTS, limit):
        h, first = near.shingles(c)
        for i in range(c.hi - c.lo):
            w = re.findall("[^\x20\x09-\x0d]+", TEXTS[c.lo + i] or "")
            want = [tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))] if w else []
            got = h[first[i] : first[i + 1]].tolist()
            assert len(got) == len(want)
            for a, b in zip(got, want, strict=True):
                assert seen.setdefault(b, a) == a
    assert len(set(seen.values())) == len(seen)


def test_pretokens_follow_the_pattern():
    # The library's white space is the Unicode property; regex's \s has four more.
    p = public_tokenizers.PATTERN.replace(r"[^\s\p{L}\p{N}]", r"[^\p{White_Space}\p{L}\p{N}]").replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")
    pattern = regex.compile(p)
    r = random.Random(5)
    parts = ["a", "s", "t", "re", "ve", "'", "'s", "'ll", "'d", " ", "  ", "\n", "\t", "\xa0", "é", "1", "٣", "!", "€", "漢", "😀", "_", "\x1c", " "]
    texts = ["".join(r.choices(parts, k=r.randrange(25))) for _ in range(4000)]
    for c in chunked(texts, 3000):
        s, e, first = bpe.pretokens(c)
        for i in range(c.hi - c.lo):
            assert [bytes(c.buf[a:b]).decode() for a, b in zip(s[first[i] : first[i + 1]], e[first[i] : first[i + 1]], strict=True)] == pattern.findall(texts[c.lo + i])


def base(text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    flags = [0] * len(w)
    for i in range(len(w) - 7):
        if n[tuple(w[i : i + 8])] > 1:
            flags[i : i + 8] = [1] * 8
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(flags)


@pytest.mark.parametrize("limit", [50, 1 << 20])
def test_quality_counts(limit):
    for c in chunked(TEXTS, limit):
        x = quality.Lines(c)
        for i in range(c.hi - c.lo):
            assert tuple(int(v[i]) for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup, x.n_repeat)) == base(TEXTS[c.lo + i])


def test_viterbi_is_the_best_path():
    r = np.random.Generator(np.random.PCG64(1))
    for n in (0, 1, 2, 7):
        score, move = r.normal(size=(n + 3, 2)), r.normal(size=(2, 2))
        got = quality.viterbi(score, np.array([0, n, n + 3]), move)
        for lo, hi in ((0, n), (n, n + 3)):
            paths = [[(k >> i) & 1 for i in range(hi - lo)] for k in range(1 << (hi - lo))]
            value = lambda p, lo=lo: sum(score[lo + i][y] for i, y in enumerate(p)) + sum(move[a][b] for a, b in zip(p, p[1:]))
            assert got[lo:hi].tolist() == max(paths, key=value)


def test_field_learns_junk_lines():
    good = ["This is a line of plain words.\nHere is another sentence for you."] * 20
    bad = ["a | b | c | d | e\n*** %%% ### $$$ &&&"] * 20
    emit, move = quality.fit(good + bad, [True] * 20 + [False] * 20)
    x = quality.Lines(next(chunked(["Some ordinary words stand here today.\nx | y | z | q | r"], 1 << 20)))
    assert quality.viterbi(x.features @ emit, x.first, move).tolist() == [0, 1]
    assert not quality.fit([], [])[0].any()


def test_suffix_arrays():
    r = random.Random(3)
    for k in range(300):
        strings = [[r.randrange(1 + (k + j) % 4) for _ in range(r.randrange(30))] for j in range(r.randrange(9))]
        want, at = [], 0
        for t in strings:
            want += [at + i for i in sorted(range(len(t)), key=lambda i: t[i:])]
            at += len(t)
        assert suffix_arrays(np.array([x for t in strings for x in t], np.int64), np.array([len(t) for t in strings], np.int64)).tolist() == want
    t = np.frombuffer(b"abracadabra" * 40, np.uint8)
    assert suffix_arrays(t.astype(np.int64), np.array([len(t)])).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tobytes())


def test_edit_distance_and_recall_of_the_embedding():
    r = random.Random(9)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randrange(12, 60)))) for i in range(60)]
    texts = []
    for _, t in items * 4:
        w = t.split()
        for _ in range(r.randrange(len(w) // 5 + 1)):
            i = r.randrange(len(w))
            w[i : i + 1] = r.choice([[], [r.choice(vocabulary)], [w[i], r.choice(vocabulary)]])
        texts.append(" ".join(r.choices(vocabulary, k=r.randrange(40)) + w + r.choices(vocabulary, k=r.randrange(40))))
    block = decontaminate.prepare(items)

    def plain(item, text):
        row = [0] * (len(text) + 1)
        for i, x in enumerate(item):
            new = [i + 1]
            for j, y in enumerate(text):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
            row = new
        return min(row)

    want = {(d, i, e) for d, t in enumerate(texts) for i, x in items if (e := plain(x.split(), t.split())) <= len(x.split()) // 5}
    for exact_only, least in ((True, 1.0), (False, 0.97)):
        got = set()
        for c in chunked(texts, 5000):
            d, k, e = decontaminate.find(*decontaminate.word_hashes(c), block, exact_only)
            got |= {(c.lo + int(a), block.ids[int(b)], int(x)) for a, b, x in zip(d, k, e, strict=True)}
        assert got <= want and len(got) >= least * len(want)
    assert len(want) >= 200


def test_bytes_before_documents_do_not_matter():
    block = decontaminate.prepare([(1, "alpha beta gamma delta epsilon zeta")])
    for texts in (["alpha beta gamma delta epsilon zeta"], ["x", "alpha beta gamma delta epsilon zeta", "y"], ["alpha beta gamma", "delta epsilon zeta"]):
        c = next(chunked(texts, 1 << 20))
        found = decontaminate.find(*decontaminate.word_hashes(c), block, False)[0].tolist()
        assert found == [i for i, t in enumerate(texts) if len(t.split()) == 6]


def test_fisher_yates_is_a_permutation_and_repeats():
    a = sharding.fisher_yates(1000, 1, 2)
    assert sorted(a) == list(range(1000)) and (a == sharding.fisher_yates(1000, 1, 2)).all()
    assert (a != sharding.fisher_yates(1000, 1, 3)).any() and sharding.fisher_yates(0, 1, 1).size == 0
    first = collections.Counter(int(sharding.fisher_yates(4, 1, b)[0]) for b in range(2000))
    assert all(400 < n < 600 for n in first.values())


def test_forest_beats_false_positives():
    forest = secrets.default_forest()
    held = secrets.labelled_findings(800, seed=77)
    right = sum((secrets.votes(forest, secrets.features_py(c, b, p, a)) >= 0.5) == bool(y) for c, b, p, a, y in held)
    assert right >= 0.97 * len(held)


def test_anchors_cover_every_match():
    marks = set(licenses.anchors(list(licenses.TEMPLATES.values())))
    for t in licenses.TEMPLATES.values():
        s = licenses.template_shingles(t)
        assert sum(not set(x.split()) & marks for x in s) < 0.8 * len(s)


def test_network_tells_two_alphabets():
    r = random.Random(2)
    a = [" ".join("".join(r.choices("abcdefg", k=5)) for _ in range(60)) for _ in range(40)]
    b = [" ".join("".join(r.choices("nopqrst", k=5)) for _ in range(60)) for _ in range(40)]
    cut = [x[k : k + 256] for x in a[:30] + b[:30] for k in (0, 50, 100)]
    net = langid.train(cut, ["a"] * 90 + ["b"] * 90, steps=60)
    w, doc, _ = langid._windows(next(chunked(a[30:] + b[30:], 1 << 20)))
    assert (net.logits(w).argmax(1) == (doc >= 10)).mean() > 0.95
    assert langid.train([], []) is None
