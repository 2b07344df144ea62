"""Language identification by a convolutional network over bytes, in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter's
maximum goes to a softmax.  The windows tile the whole text (the last is padded with spaces); the
prediction is the mean of their softmaxes, weighted by their bytes.

The network is fitted on a bounded sample: at most ``PER_LANG`` documents of each language, and of
each ``WINDOWS`` windows from anywhere in its text, cut where the text is.

Defined results: a null text or one without a letter is ``und`` with score 0; with nothing to
learn from, so is every text; repeated rows give repeated rows; an empty table an empty result; all
windows of a very long text count; carried columns may have any names but ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.shared import bound_batches

PER_LANG, WINDOWS = 200, 5
WINDOW, DIM, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 10
UND = "und"


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray
    conv: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        return self.pooled(windows)[0] @ self.out + self.out_bias

    def pooled(self, windows: np.ndarray, where: bool = False):
        """Each filter's maximum over each window, and where it stands."""
        n, width = windows.shape
        x = self.embed[windows]
        wide = max(WIDTHS)
        steps = width - wide + 1
        cols = np.lib.stride_tricks.as_strided(x, (n, steps, wide * DIM), x.strides)
        y = (np.ascontiguousarray(cols).reshape(n * steps, wide * DIM) @ self.conv).reshape(n, steps, -1)
        at = y.argmax(1) if where else None
        return np.maximum(y.max(1) + self.bias, 0), at, cols


def _mask() -> np.ndarray:
    """Which weights a filter of each width has; the rest stay zero."""
    m = np.zeros((max(WIDTHS) * DIM, len(WIDTHS) * FILTERS), np.float32)
    for i, w in enumerate(WIDTHS):
        m[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    return m


def train(texts: list[str], langs: list[str], steps: int = 260, batch: int = 96, seed: int = 7) -> Net | None:
    """Adam on the softmax loss over windows (texts of up to WINDOW bytes), classes in equal parts; the same data give the same net."""
    rng = np.random.Generator(np.random.PCG64(seed))
    names = sorted(set(langs))
    windows, labels = [], []
    for text, lang in sorted(zip(texts, langs, strict=True)):
        w = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        windows.append(np.concatenate([w, np.full(WINDOW - len(w), 32, np.uint8)]))
        labels.append(names.index(lang))
    if not windows:
        return None
    windows, labels = np.array(windows), np.array(labels)
    upper = windows.copy()
    upper[(upper >= 97) & (upper <= 122)] -= 32
    windows, labels = np.concatenate([windows, upper[::4]]), np.concatenate([labels, labels[::4]])
    by_lang = [np.flatnonzero(labels == k) for k in range(len(names))]
    f, mask = len(WIDTHS) * FILTERS, _mask()
    norm = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
    net = Net(names, norm(256, DIM, scale=0.5), norm(max(WIDTHS) * DIM, f, scale=0.25) * mask, np.zeros(f, np.float32), norm(f, len(names), scale=0.3), np.zeros(len(names), np.float32))
    keys = ("embed", "conv", "bias", "out", "out_bias")
    m, v = ({k: np.zeros_like(getattr(net, k)) for k in keys} for _ in range(2))
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(ix, -(-batch // len(names))) for ix in by_lang if len(ix)])
        b, y = windows[pick], labels[pick]
        h, at, cols = net.pooled(b, where=True)
        z = h @ net.out + net.out_bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        g = {"out": h.T @ p, "out_bias": p.sum(0)}
        dh = (p @ net.out.T) * (h > 0)
        g["bias"] = dh.sum(0)
        rows = np.repeat(np.arange(len(y)), f)
        patch = cols[rows, at.ravel()].reshape(len(y), f, -1)
        g["conv"] = np.einsum("nfk,nf->kf", patch, dh) * mask
        back = (dh[:, :, None] * net.conv.T[None]).reshape(len(y) * f, max(WIDTHS), DIM)
        g["embed"] = np.zeros_like(net.embed)
        for j in range(max(WIDTHS)):
            np.add.at(g["embed"], b[rows, at.ravel() + j], back[:, j])
        for k in keys:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
            getattr(net, k)[...] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def _windows(c: bv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a chunk's documents, their documents and their bytes."""
    size = np.diff(c.offs)
    count = -(-size // WINDOW)
    doc = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = c.offs[:-1][doc] + nth * WINDOW
    length = np.minimum(WINDOW, c.offs[1:][doc] - begin)
    at = begin[:, None] + np.arange(WINDOW)
    out = np.concatenate([c.buf, np.zeros(WINDOW, np.uint8)])[at]
    out[np.arange(WINDOW)[None] >= length[:, None]] = 32
    return out, doc, length


def predict(docs: DataFrame, net: Net | None, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), batch: int = 128) -> DataFrame:
    """``carry`` columns plus lang_pred and score, in one pass without a shuffle."""
    bound_batches(docs.sparkSession)
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            lettered = rows.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            for c in bv.chunks(rows.column(len(names))):
                n = c.hi - c.lo
                label, score = np.full(n, UND, object), np.zeros(n)
                if net is not None and len(c.buf):
                    windows, doc, length = _windows(c)
                    total = np.zeros((n, len(net.langs)))
                    for i in range(0, len(windows), batch):
                        z = net.logits(windows[i : i + batch])
                        p = np.exp(z - z.max(1, keepdims=True))
                        p *= (length[i : i + batch] / p.sum(1))[:, None]
                        np.add.at(total, doc[i : i + batch], p)
                    has = lettered[c.lo : c.hi] & (np.diff(c.offs) > 0)
                    best = total.argmax(1)
                    label[has] = np.array(net.langs, object)[best[has]]
                    score[has] = np.minimum(1.0, total[has, best[has]] / np.diff(c.offs)[has])
                held = [rows.column(i).slice(c.lo, n) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*held, pa.array(label, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    x = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    kinds = "".join(f"`{n}` {x.schema[n].dataType.simpleString()}, " for n in names)
    out = x.mapInArrow(run, kinds + "lang_pred string, score double")
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], "lang_pred", "score")


def training_sample(docs: DataFrame, usable: Column, per_lang: int = PER_LANG, windows: int = WINDOWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """Windows and languages of at most ``per_lang`` documents of each language: of each slot of a hash of the ids, the smallest id; a window begins anywhere in its text."""
    known = docs.filter(usable & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    ids = known.groupBy("lang", F.pmod(F.xxhash64("id"), F.lit(per_lang)).alias("slot")).agg(F.min("id").alias("id")).select("id", "lang")
    wanted = docs.sparkSession.createDataFrame([tuple(r) for r in ids.collect()], known.select("id", "lang").schema)
    places = F.greatest(F.length("text") - WINDOW + 1, F.lit(1))
    cut = F.transform(F.sequence(F.lit(1), F.lit(windows)), lambda k: F.substring("text", F.pmod(F.xxhash64("id", k), places).cast("int") + 1, F.lit(WINDOW)))
    rows = known.join(F.broadcast(wanted), ["id", "lang"], "left_semi").select(F.explode(cut).alias("w"), "lang").collect()
    return [r[0] for r in rows], [r[1] for r in rows]
