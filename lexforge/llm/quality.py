"""Quality rules: a linear-chain conditional random field labels lines as content or boilerplate.

Base rules come from word and line counts.  Documents that pass them are judged by the share of
their words that stands in content lines, as decoded by Viterbi over the two labels.

The field is fitted on a bounded sample of labelled documents (``SAMPLE`` of each quality, whole
texts): lines of good documents begin as content, lines of
bad ones as boilerplate, and one round of relabelling by the fitted field lets bad documents keep
the lines that look like content.

Defined results: a null or empty text has no words and fails the base rules; repeated rows give
repeated rows; an empty table gives an empty result; without labelled documents every line counts
as content; a very long text is judged whole, in a slice of its own; carried columns may have any
names but those of the counts, which come under theirs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.shared import bound_batches, gives_back

SAMPLE = 600
LEAST_CONTENT = 0.5
N_FEATURES = 12
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER, _LOWER, _DIGIT, _STOP = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91], _LOWER[97:123], _DIGIT[48:58], _STOP[list(b".!?:;,|")] = True, True, True, True


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(keys)
    s = keys[order]
    same = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


class Lines:
    """A chunk's lines that have a word, and the counts of its documents."""

    def __init__(self, c: bv.Chunk):
        buf, offs, n_docs = c.buf, c.offs, len(c.offs) - 1
        starts, ends, first = bv.words(c)
        hasher = c.hasher()
        tally = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offs])
        self.n_words = np.diff(first)
        self.word_chars = tally(~bv.ASCII_SPACE[buf] & ((buf & 0xC0) != 0x80))
        self.n_symbols = tally(_SYMBOL[buf])
        word_doc = np.repeat(np.arange(n_docs), self.n_words)
        salt = bv.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
        wh = hasher.of(starts, ends)
        # Words in windows of eight that come again in the same document.
        self.n_repeat = np.zeros(n_docs, np.int64)
        eight = bv.spans(wh, 8)
        if len(eight):
            inside = np.flatnonzero(word_doc[: len(eight)] == word_doc[7:])
            hit = inside[_repeats(eight[inside] ^ salt[word_doc[inside]])]
            step = np.zeros(len(wh) + 1, np.int64)
            step[hit] += 1
            np.subtract.at(step, hit + 8, 1)
            self.n_repeat = np.diff(np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])[first])
        # Lines with a word, by the first and last byte of each.
        cut = np.flatnonzero(buf == 10)
        edges = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut + 1])) if len(buf) else np.zeros(0, np.int64)
        edges = edges[edges < len(buf)]
        line_of = np.searchsorted(edges, starts, "right") - 1
        has, at = np.unique(line_of, return_index=True)
        begin = edges[has]
        doc = word_doc[at] if len(at) else np.zeros(0, np.int64)
        stop = np.append(edges[1:], len(buf))[has]
        stop = stop - (buf[stop - 1] == 10) if len(stop) else stop
        words = np.diff(np.append(at, len(starts)))
        key = hasher.of(begin, stop) ^ salt[doc]
        _, earliest = np.unique(key, return_index=True)
        again = np.ones(len(key), bool)
        again[earliest] = False
        self.n_dup = np.bincount(doc[again], minlength=n_docs)
        self.doc, self.words = doc, words
        self.first = np.searchsorted(doc, np.arange(n_docs + 1))
        size = (stop - begin).astype(np.float64)
        upto = lambda flags: (lambda s: s[stop] - s[begin])(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)]))
        symbols, upper, lower, digits = upto(_SYMBOL[buf]), upto(_UPPER[buf]), upto(_LOWER[buf]), upto(_DIGIT[buf])
        pipes, bangs = upto(buf == 0x7C), upto(buf == 0x21)
        line_word = np.repeat(np.arange(len(words)), words)
        twice = _repeats(wh ^ bv.mix(line_word.astype(np.uint64) + np.uint64(1))) if len(wh) else np.zeros(0, bool)
        same = np.bincount(line_word[twice], minlength=len(words)) if len(words) else np.zeros(0)
        close = _STOP[buf[stop - 1]] if len(stop) else np.zeros(0, bool)
        one = np.ones(len(words))
        self.features = np.stack([one, np.minimum(symbols / size, 0.3) * 5, symbols > 0.02 * size, np.minimum(pipes / words, 1), upper > lower, np.minimum(bangs / words, 1), same / words * (words > 3), same > 0.6 * words, again, words < 4, np.minimum(digits / size, 0.5) * 2, close], 1).astype(np.float64) if len(words) else np.zeros((0, N_FEATURES))


def fit(texts: list[str], good: list[bool], rounds: int = 2, steps: int = 120) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the emission (features by label) and the transition (label by label); label 0 is content."""
    emit, move = np.zeros((N_FEATURES, 2)), np.zeros((2, 2))
    if not texts:
        return emit, move
    feats, labels, sizes = [], [], []
    for c in bv.chunks(pa.array(texts, pa.string())):
        x = Lines(c)
        feats.append(x.features)
        sizes.append(np.diff(x.first))
        labels.append(np.where(np.array(good)[c.lo + x.doc] if len(x.doc) else [], 0, 1).astype(np.int64))
    x, y, n = np.concatenate(feats), np.concatenate(labels), np.concatenate(sizes)
    if not len(x):
        return emit, move
    piece = 64  # long documents count as several sequences
    cuts = np.unique(np.concatenate([np.concatenate([[0], np.cumsum(n)]), np.arange(0, len(x), piece)]))
    starts, lens = cuts[:-1], np.diff(cuts)
    for r in range(rounds):
        emit, move = _ascend(x, y, starts, lens, emit, move, steps)
        if r + 1 < rounds:
            bad = y == 1
            score = x @ emit
            y = np.where(bad & (score[:, 0] > score[:, 1]), 0, y)
    return emit, move


def _ascend(x, y, starts, lens, emit, move, steps) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the conditional log likelihood, gradients by forward and backward sums over all sequences at once."""
    order = np.argsort(-lens, kind="stable")
    starts, lens = starts[order], lens[order]
    longest = int(lens[0])
    active = [int(np.searchsorted(-lens, -t, "left")) for t in range(longest)]  # sequences longer than t
    want_e = np.stack([x[y == k].sum(0) for k in (0, 1)], 1)
    pair = np.ones(len(x), bool)
    pair[starts] = False
    prev, cur = y[:-1][pair[1:]], y[1:][pair[1:]]
    want_m = np.bincount(prev * 2 + cur, minlength=4).reshape(2, 2).astype(float)
    weight, m, v = np.concatenate([emit.ravel(), move.ravel()]), 0.0, 0.0
    for step in range(1, steps + 1):
        e, t = weight[:-4].reshape(-1, 2), weight[-4:].reshape(2, 2)
        score = x @ e
        alpha, beta = np.zeros((len(x), 2)), np.zeros((len(x), 2))
        alpha[starts] = score[starts]
        for k in range(1, longest):
            at = starts[: active[k]] + k
            alpha[at] = score[at] + np.logaddexp(alpha[at - 1, :1] + t[0], alpha[at - 1, 1:] + t[1])
        for k in range(longest - 2, -1, -1):
            at = starts[: active[k + 1]] + k
            s = score[at + 1] + beta[at + 1]
            beta[at] = np.logaddexp(s[:, :1] + t[:, 0], s[:, 1:] + t[:, 1])
        ends = starts + lens - 1
        z = np.empty(len(x))
        z[bv.ragged(starts, lens)] = np.repeat(np.logaddexp(alpha[ends, 0], alpha[ends, 1]), lens)
        p = np.exp(alpha + beta - z[:, None])
        have_e = x.T @ p
        i = np.flatnonzero(pair)
        joint = alpha[i - 1][:, :, None] + t[None] + (score[i] + beta[i])[:, None, :] - z[i][:, None, None]
        have_m = np.exp(joint).sum(0)
        g = np.concatenate([(want_e - have_e).ravel(), (want_m - have_m).ravel()]) / len(x) - 1e-3 * weight
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        weight = weight + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return weight[:-4].reshape(-1, 2), weight[-4:].reshape(2, 2)


def viterbi(score: np.ndarray, first: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best label of each line; sequences are first[i]..first[i+1].  A tie goes to content."""
    lens = np.diff(first)
    order = np.argsort(-lens, kind="stable")
    starts, lens = first[:-1][order], lens[order]
    out = np.zeros(len(score), np.int64)
    longest = int(lens[0]) if len(lens) else 0
    if not longest:
        return out
    best, came = score.copy(), np.zeros((len(score), 2), np.int8)
    counts = np.searchsorted(-lens, -np.arange(longest), "left")
    for k in range(1, longest):
        at = starts[: counts[k]] + k
        before = best[at - 1]
        for to in (0, 1):
            stay, cross = before[:, 0] + move[0, to], before[:, 1] + move[1, to]
            came[at, to] = cross > stay
            best[at, to] += np.maximum(stay, cross)
    for k in range(longest - 1, -1, -1):
        n = counts[k]
        at = starts[:n] + k
        more = counts[k + 1] if k + 1 < longest else 0
        out[at[more:]] = best[at[more:], 1] > best[at[more:], 0]
        nxt = at[:more]
        out[nxt] = came[nxt + 1, out[nxt + 1]]
    return out


def training_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[bool]]:
    """Texts of ``sample`` documents of each quality, those whose ids hash lowest."""
    ids: dict = {}
    for quality in (0, 1):
        rows = labels.filter((F.col("quality") == quality) & F.col(id_col).isNotNull()).select(id_col).orderBy(F.xxhash64(id_col), id_col).limit(sample).collect()
        for r in rows:
            ids.setdefault(r[0], quality)
    if not ids:
        return [], []
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}")
    rows = docs.filter(F.col(text_col).isNotNull()).join(F.broadcast(wanted), id_col, "left_semi").select(id_col, text_col).collect()
    rows = sorted((r[0], r[1]) for r in rows)
    return [t for _, t in rows], [ids[i] == 1 for i, _ in rows]


COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_words bigint"


def judge(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), least_content: float = LEAST_CONTENT) -> DataFrame:
    """``carry`` columns plus counts and verdict of each document; no shuffle, one pass over the texts."""
    bound_batches(docs.sparkSession)
    emit, move = weights
    at = carry.index(text_col) if text_col in carry else len(carry)
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in bv.chunks(batch.column(at)):
                x = Lines(c)
                content = viterbi(x.features @ emit, x.first, move) == 0
                n_content = np.bincount(x.doc[content], x.words[content], minlength=c.hi - c.lo).astype(np.int64)
                failed = (x.n_words < 20) | (100 * x.n_repeat > 30 * x.n_words)
                kept = ~failed & (n_content >= least_content * x.n_words)
                cols = [x.n_words, x.word_chars, x.n_symbols, x.n_dup, x.n_repeat]
                held = [batch.column(i).slice(c.lo, c.hi - c.lo) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(v.astype(np.int64)) for v in cols), pa.array(failed), pa.array(kept), pa.array(n_content)], names=[*names, *(f.split()[0] for f in COUNTS.split(", "))])

    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], *([] if text_col in carry else [F.col(text_col).alias("text")]))
    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    out = rows.mapInArrow(gives_back(run), kinds + COUNTS)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], *(f.split()[0] for f in COUNTS.split(", ")))
