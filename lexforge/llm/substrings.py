"""Repeated byte strings, by suffix arrays that are built in linear time from Lyndon-prefix groups.

A window is ``LENGTH`` bytes of one text.  Every window names one anchor: of its ``GRAM``-byte
strings the one with the smallest hash (the last of equals), so equal windows name equal anchors at
the same place.  The windows that name one anchor of a text are neighbours and form a stretch.
Hashes do no more than choose which stretches meet: those of an anchor that more than one stretch
names (or of one that may repeat itself).

Anchors that the same texts name about the same place (``SPAN``) go together by a hash of these, so
neighbouring stretches make one piece and their bytes in common are sorted once.  Any function of
the anchor alone would be right: equal windows name equal anchors and meet.

The stretches that meet are joined into one string, its suffixes are sorted
(``lyndon.suffix_arrays``), and a window is repeated where its suffix agrees with a neighbour's in
the order for LENGTH bytes.  That decides every window.  A stretch that agrees with no other one
around the anchor for as long as an equal window needs has no such neighbour and isn't sorted
(``may_repeat``, asked for each stretch of a piece).

An anchor may be named by a third of all texts, so its stretches are dealt to blocks of about
``BLOCK``.  Of a block's stretches that agree in every byte two are sorted; what the order says of
the first holds for further copies.  About ``SORTED`` of them make a string.  Where an anchor has
several strings, each of these tells the windows that it finds repeated and passes on one of each
of its different windows; these meet again, under anchors of the
next longer size in ``LADDER`` so that different surroundings part.  Copies shrink by the size of a
block in each round, and the last size is the window itself, so the rounds come to an end.

Repeated bytes are removed by document.  Nothing is sampled, and no group is cut.

Defined results: null texts count as empty; texts shorter than LENGTH keep all bytes; strings are
judged on the input, overlaps count, copies inside one text count; repeated rows are copies of one
another; ids may have any type, null included (rows are told apart by 96 bits of id and text, rows
alike in both share their ranges); a very long text is cut into stretches like any other, and its
bytes are held once by the task that cuts it; an empty table gives an empty result; only the id and
text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.lyndon import suffix_arrays
from lexforge.llm.shared import bound_batches, ready_checkpoints, stored

LENGTH, GRAM, LADDER, BLOCK, RUN_BYTES = 200, 32, (96, 160, 192, 200), 64, 8 << 20
#: Pieces of a block that make one string.
SORTED = 16
#: Ranges of an anchor's place in its window, by which pieces are told apart before they are sorted.
RANGES = 4
#: Windows of a text that go together, about.
SPAN = 1024


def stretches(c: bv.Chunk, length: int = LENGTH, gram: int = GRAM, ask_own: bool = False, every: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, first window, windows, whether its own windows may be equal, false unless asked) of all stretches of a chunk; windows count from the chunk's first byte."""
    n, width = len(c.buf), length - gram + 1
    m = n - length + 1
    size = np.diff(c.offs)
    if m <= 0 or not (size >= length).any():
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    every, span = c.hasher().every(gram) if every is None else every, 1
    low = every
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:m], low[width - span : width - span + m])
    step = np.zeros(m + 1, np.int8)
    long = size >= length
    np.add.at(step, c.offs[:-1][long], 1)
    np.add.at(step, c.offs[1:][long] - length + 1, -1)
    inside = np.cumsum(step[:m]) > 0
    fresh = np.ones(m, bool)
    fresh[1:] = (low[1:] != low[:-1]) | ~inside[:-1]
    fresh[c.offs[:-1][long]] = True
    first = np.flatnonzero(fresh & inside)
    doc = np.searchsorted(c.offs, first, "right") - 1
    stop = np.minimum(np.append(first[1:], m), c.offs[1:][doc] - length + 1)
    # Ties in the hashes can make a stretch long; any cut is as good as another.
    pieces = -(-(stop - first) // width)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        stop, doc = np.repeat(stop, pieces), np.repeat(doc, pieces)
        first = np.repeat(first, pieces) + nth * width
        stop = np.minimum(stop, first + width)
    # Where a stretch has its anchor's string twice, windows of its own may be equal.
    value = low[first]
    if not ask_own:
        return value, doc, first, stop - first, np.zeros(len(first), bool)
    seen = np.zeros(1 << 20, bool)
    seen[value >> np.uint64(44)] = True
    at = np.flatnonzero(seen[every >> np.uint64(44)])
    at = at[np.argsort(every[at], kind="stable")]
    _, rank = np.unique(every[at], return_inverse=True)
    keys = rank.astype(np.int64) << 32 | at
    mine = rank[np.searchsorted(every[at], value)].astype(np.int64) << 32
    own = np.searchsorted(keys, mine | (stop - 1 + width)) - np.searchsorted(keys, mine | first) > 1
    return value, doc, first, stop - first, own


def _columns(batch: pa.RecordBatch, length: int, gram: int, ask_own: bool = False) -> tuple[np.ndarray, ...]:
    parts = []
    for c in bv.chunks(batch.column(2)):
        a, doc, first, windows, own = stretches(c, length, gram, ask_own)
        parts.append((a.view(np.int64), c.lo + doc, first - c.offs[doc], windows, own))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool),)


def _counted(length: int, gram: int):
    """Anchors of each batch of rows, with their numbers of stretches, a sum of hashes of the texts that name them, and the first stretch of a text that does, in units of ``SPAN``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, doc, first, _, own = _columns(batch, length, gram, True)
            keys, at, n = np.unique(a, return_inverse=True, return_counts=True)
            k, mark = (batch.column(x).to_numpy().astype(np.int64).view(np.uint64) for x in (0, 1))
            texts, place = np.zeros(len(keys), np.int64), np.full(len(keys), np.iinfo(np.int32).max, np.int32)
            np.add.at(texts, at, (bv.mix(k ^ bv.mix(mark)) >> np.uint64(24)).view(np.int64)[doc])
            np.minimum.at(place, at, (first // SPAN).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(np.bincount(at[own], minlength=len(keys)) > 0), pa.array(texts), pa.array(place)], names=["anchor", "n", "own", "texts", "place"])

    return run


def _listed(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, doc, first, windows, _ = _columns(batch, length, gram)
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays([pa.array(a), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(first.astype(np.int32)), pa.array(windows.astype(np.int16))], names=["anchor", "k", "mark", "first", "windows"])

    return run


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, for the shuffle."""
    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        raw, offs = bv.buffers(batch.column(3))
        texts = [pack(raw[a:b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(texts, pa.binary())], names=["k", "mark", "own", "text"])


def _texts(column: pa.Array) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(x), np.uint8) for x in column.to_pylist()]


_PIECE = "anchor bigint, several boolean, block int, k bigint, mark int, first int, windows int, known boolean, bytes binary"


def _cut_out(length: int):
    """Rows (k, mark, own, text, wanted stretches or null) -> the stretches with their bytes; neighbours that go to one place are one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = whole.filter(whole.column("wanted").is_valid())
            for lo in range(0, some.num_rows, 500):
                batch = some.slice(lo, 500)
                wanted = batch.column("wanted")
                flat, counts = wanted.flatten(), np.diff(wanted.offsets.to_numpy())
                first, windows, anchor, block = (flat.field(x).to_numpy().astype(np.int64) for x in ("first", "windows", "anchor", "block"))
                row = np.repeat(np.arange(batch.num_rows), counts)
                sort = np.lexsort((first, row))
                row, first, windows, anchor, block = (x[sort] for x in (row, first, windows, anchor, block))
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (anchor[1:] != anchor[:-1]) | (block[1:] != block[:-1]) | (first[1:] != (first + windows)[:-1])
                head = np.flatnonzero(fresh)
                windows = np.add.reduceat(windows, head)
                flat, row, first = flat.take(pa.array(sort[head])), row[head], first[head]
                counts = np.bincount(row, minlength=batch.num_rows)
                data, k = [], 0
                for text, n in zip(_texts(batch.column("text")), counts.tolist(), strict=True):
                    data.append(text[bv.ragged(first[k : k + n], windows[k : k + n] + length - 1)])
                    k += n
                offs = np.concatenate([[0], np.cumsum(windows + length - 1)])
                held = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offs), pa.py_buffer(np.concatenate(data))]).cast(pa.binary())
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), flat.field("several"), flat.field("block"), batch.column("k").take(rows), batch.column("mark").take(rows), flat.field("first"), pa.array(windows.astype(np.int32)), pa.array(np.zeros(len(first), bool)), held], names=[x.split()[0] for x in _PIECE.split(", ")])

    return run


def repeated_windows(text: np.ndarray, cuts: np.ndarray, strings: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in order of their suffixes, and whether each equals the one before.

    ``text`` holds pieces one after another (piece i is cuts[i]..cuts[i + 1]), ``strings`` says how
    many pieces make each string, ``starts`` are the places of windows, none of which crosses a piece.
    """
    size = np.diff(cuts)
    place = np.arange(len(text)) + np.repeat(np.arange(len(size)), size)  # a zero follows each piece
    symbols = np.zeros(len(text) + len(size), np.uint16)
    symbols[place] = text.astype(np.uint16) + np.uint16(1)
    ends = np.concatenate([[0], np.cumsum(strings)])
    lengths = (cuts[ends[1:]] - cuts[ends[:-1]]) + strings
    order = suffix_arrays(symbols, lengths)
    back = np.full(len(symbols), -1, np.int64)
    back[place[starts]] = starts
    order = back[order]
    order = order[order >= 0]
    string = np.searchsorted(cuts[ends], order, "right")
    same = np.zeros(len(order), bool)
    wide = np.ndarray(max(0, len(text) - length + 1), f"V{length}", text.data, 0, (1,))
    for lo in range(0, len(order) - 1, 1 << 13):  # pieces that stay in the cache
        w = wide[order[lo : lo + (1 << 13) + 1]]
        same[lo + 1 : lo + len(w)] = w[1:] == w[:-1]
    same[1:] &= string[1:] == string[:-1]
    return order, same


def copies(group: np.ndarray, text: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the first of its group that has its bytes (itself, where it is that), and how many copies come before it.

    Pieces with one hash are compared by their bytes; one that differs from the first counts as its own.
    """
    size, n = np.diff(cuts), len(group)
    value = bv.Hasher(text)
    lanes, value = value.lanes, value.of(cuts[:-1], cuts[1:])
    sort = np.lexsort((value, size, group))
    fresh = np.ones(n, bool)
    fresh[1:] = (value[sort[1:]] != value[sort[:-1]]) | (size[sort[1:]] != size[sort[:-1]]) | (group[sort[1:]] != group[sort[:-1]])
    head = np.flatnonzero(fresh)
    count = np.diff(np.append(head, n))
    at = np.flatnonzero(~fresh)
    mine, other = sort[at], np.repeat(sort[head], count)[at]
    alike, a, b, left = np.ones(len(at), bool), cuts[mine], cuts[other], size[mine]
    for t in range(0, int(left.max(initial=0)), 8):
        open_ = np.flatnonzero(left > t)
        alike[open_] &= ((lanes[a[open_] + t] ^ lanes[b[open_] + t]) & bv.MASKS[np.minimum(left[open_] - t, 8)]) == 0
    first, nth = np.arange(n), np.zeros(n, np.int64)
    first[mine[alike]] = other[alike]
    same = ~fresh
    same[at] = alike
    before = np.cumsum(same)
    nth[sort] = np.where(same, before - np.repeat(before[head], count), 0)
    return first, nth


def may_repeat(group: np.ndarray, text: np.ndarray, start: np.ndarray, stop: np.ndarray, own: np.ndarray, at: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Stretches (places start..stop of the text, which hold their anchor's string at the places ``at``, by owner) of which a window may equal another one of the group; no window of the others does.

    Equal windows hold their anchor's string at the same place x.  If x lies between s and t, they
    agree from s before that string to ``length`` - t behind its start, for every range s..t of
    ``RANGES``.  So a stretch that holds the string once, and has none of these agreements by hash
    with another place of it, has no equal window; hashes that meet by chance do no more than keep a stretch.
    """
    maybe = np.bincount(own, minlength=len(group)) != 1
    hasher, bounds = bv.Hasher(text), np.linspace(0, length - gram, RANGES + 1).astype(np.int64).tolist()
    for s, t in zip(bounds[:-1], bounds[1:], strict=True):
        inside = np.flatnonzero((at - s >= start[own]) & (at + length - t <= stop[own]))
        low = at[inside] - s
        key = bv.mix(hasher.of(low, low + s + length - t) ^ bv.mix(group[own[inside]].astype(np.uint64)))
        _, which, count = np.unique(key, return_inverse=True, return_counts=True)
        maybe[own[inside[count[which] > 1]]] = True
    return maybe


def parts(text: np.ndarray, cuts: np.ndarray, group: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, windows, whether any of them may repeat) of the parts of each piece; its stretches are told apart by ``may_repeat``, and neighbours that are alike in it are one part."""
    found, held, n = [], pa.Array.from_buffers(pa.large_binary(), len(group), [None, pa.py_buffer(cuts), pa.py_buffer(text)]), 0
    for c in bv.chunks(held):
        every = c.hasher().every(gram)
        anchor, piece, first, windows, _ = stretches(c, length, gram, every=every)
        places = windows + length - gram
        at = bv.ragged(first, places)
        own = np.repeat(np.arange(len(first)), places)
        hold = np.flatnonzero(every[at] == np.repeat(anchor, places))
        found.append((piece + c.lo, first + cuts[c.lo], windows, own[hold] + n, at[hold] + cuts[c.lo]))
        n += len(first)
    piece, first, windows, own, at = (np.concatenate(x) for x in zip(*found, strict=True))
    maybe = may_repeat(group[piece], text, first, first + windows + length - 1, own, at, length, gram)
    head = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (maybe[1:] != maybe[:-1])]))
    return piece[head], first[head], np.add.reduceat(windows, head), maybe[head]


_TOLD = "anchor bigint, k bigint, mark int, first int, windows int, known boolean, bytes binary"


def _strings(group: np.ndarray, same_as: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces in order of group and first copy -> where strings of about ``SORTED`` pieces begin, and their pieces; two copies stay together."""
    n = len(group)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_group = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.flatnonzero(of_group)
    inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    twin = np.concatenate([[False], same_as[1:] == same_as[:-1]])
    part = (inside - twin) // SORTED
    head = np.flatnonzero(of_group | np.concatenate([[True], part[1:] != part[:-1]]))
    return head, np.diff(np.append(head, n))


def _resolved(length: int, gram: int, run_bytes: int, held_gram: int = GRAM):
    """Pieces under anchors of ``held_gram`` bytes, a block's together -> runs of windows found repeated (bytes null); of blocks that aren't alone also one of each different window, under the next anchors."""

    def resolve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        raw, offs = bv.buffers(rows.column("bytes"))
        text, cuts = raw[offs[0] : offs[-1]], offs - offs[0]
        key = np.stack([rows.column("anchor").to_numpy(), rows.column("block").to_numpy()], 1)
        group = np.cumsum(np.concatenate([[0], (key[1:] != key[:-1]).any(1)]))
        windows, first = (rows.column(x).to_numpy().astype(np.int64) for x in ("windows", "first"))
        known, several = (rows.column(x).to_numpy(zero_copy_only=False).astype(bool) for x in ("known", "several"))
        k, mark = rows.column("k").to_numpy(), rows.column("mark").to_numpy()
        # Two of each different piece are sorted, side by side; the order's word on the first holds for further copies.
        same_as, nth = copies(group, text, cuts)
        chosen = np.flatnonzero(nth < 2)
        chosen = chosen[np.lexsort((chosen, same_as[chosen], group[chosen]))]
        every, all_cuts, all_windows, all_known, whole = (k, mark, first), cuts, windows, known, same_as
        sizes = np.diff(cuts)[chosen]
        held, cuts = text[bv.ragged(cuts[:-1][chosen], sizes)], np.concatenate([[0], np.cumsum(sizes)])
        place = np.zeros(len(group), np.int64)
        place[chosen] = cuts[:-1]
        piece, at, windows, maybe = parts(held, cuts, group[chosen], length, held_gram)
        # Parts that aren't sorted come behind the others: each of their windows is one of its own.
        sort = np.argsort(~maybe, kind="stable")
        piece, at, windows, n_sorted = piece[sort], at[sort], windows[sort], int(maybe.sum())
        first = first[chosen[piece]] + at - cuts[piece]
        k, mark, known, several, group, same_as = (x[chosen[piece]] for x in (k, mark, known, several, group, same_as))
        head, strings = _strings(group[:n_sorted], same_as[:n_sorted])
        several[:n_sorted] |= (np.bincount(group[head], minlength=int(group.max()) + 1) > 1)[group[:n_sorted]]
        text, cuts = held[bv.ragged(at, windows + length - 1)], np.concatenate([[0], np.cumsum(windows + length - 1)])
        end = cuts[n_sorted]
        order, same = repeated_windows(text[:end], cuts[: n_sorted + 1], strings, bv.ragged(cuts[:n_sorted], windows[:n_sorted]), length)
        order = np.concatenate([order, bv.ragged(cuts[n_sorted:-1], windows[n_sorted:])])
        same = np.concatenate([same, np.zeros(len(order) - len(same), bool)])
        begin = np.flatnonzero(~same)
        count = np.diff(np.append(begin, len(order)))
        owner = np.searchsorted(cuts, order, "right") - 1
        hit = np.zeros(len(held), bool)
        told_of = order[np.repeat(count, count) > 1]
        hit[told_of + np.repeat(at - cuts[:-1], np.diff(cuts))[told_of]] = True
        found = bv.ragged(all_cuts[:-1], all_windows)[hit[bv.ragged(place[whole], all_windows)] & ~np.repeat(all_known, all_windows)]

        def runs(at: np.ndarray, flag: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places in order -> owners, places and lengths of runs of neighbours in a piece that are alike in ``flag``."""
            own = np.searchsorted(cuts, at, "right") - 1
            fresh = np.ones(len(at), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1) | (flag[1:] != flag[:-1])
            i = np.flatnonzero(fresh)
            return own[i], at[i], np.diff(np.append(i, len(at)))

        def told(anchor, pieces, own, place, n, flag, data) -> pa.RecordBatch:
            k, mark, first = pieces
            return pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(k[own]), pa.array(mark[own]), pa.array((first[own] + place).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(flag, pa.bool_()), data], names=[x.split()[0] for x in _TOLD.split(", ")])

        own, place, n = runs(found, np.zeros(len(found), bool), all_cuts)
        yield told(np.zeros(len(own), np.int64), every, own, place - all_cuts[own], n, np.ones(len(own), bool), pa.nulls(len(own), pa.binary()))
        if not several.any() or not len(order):
            return
        least = np.minimum.reduceat(order, begin)
        whether = (count > 1) | (np.maximum.reduceat(known[owner].astype(np.int8), begin) > 0)
        sort = np.argsort(least)
        least, whether = least[sort], whether[sort]
        left = several[np.searchsorted(cuts, least, "right") - 1]
        own, place, n = runs(least[left], whether[left], cuts)
        flag = whether[left][np.searchsorted(least[left], place)]
        size = n + length - 1
        pieces = bv.Chunk(0, len(own), text[bv.ragged(place, size)], np.concatenate([[0], np.cumsum(size)]))
        anchor, doc, at, n, _ = stretches(pieces, length, gram)
        data = pieces.buf[bv.ragged(at, n + length - 1)]
        held = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(n + length - 1)])), pa.py_buffer(data)]).cast(pa.binary())
        yield told(anchor.view(np.int64), (k, mark, first), own[doc], place[doc] - cuts[own[doc]] + at - pieces.offs[doc], n, flag[doc], held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(0).to_numpy(), batch.column(2).to_numpy()], 1)
            sums = bv.buffers(batch.column(8))[1]
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if size >= run_bytes and tuple(key[lo]) != last:
                    yield from resolve(pa.Table.from_batches(held))
                    held, size = [], 0
                held.append(batch.slice(lo, hi - lo))
                size += int(sums[hi] - sums[lo])
                last = tuple(key[lo])
        if held:
            yield from resolve(pa.Table.from_batches(held))

    return run


def _remove(length: int):
    """Rows (k, mark, own, text, ranges) -> own, counts, what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                size, gone, spans, left = [], [], [], []
                for data, own in zip(_texts(batch.column("text")), batch.column("ranges").to_pylist(), strict=True):
                    n = len(data)
                    if own:
                        step = np.zeros(n + 1, np.int64)
                        a = np.array([(r["first"], r["first"] + r["windows"] - 1 + length) for r in own])
                        np.add.at(step, a[:, 0], 1)
                        np.add.at(step, a[:, 1], -1)
                        keep = np.cumsum(step)[:n] <= 0
                        gone.append(int(n - keep.sum()))
                        spans.append(int((~keep & np.append(True, keep[:-1])).sum()))
                        left.append(data[keep].tobytes())
                    else:
                        gone.append(0)
                        spans.append(0)
                        left.append(data.tobytes())
                    size.append(n)
                yield pa.RecordBatch.from_arrays([batch.column("own"), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(left, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def _blocks(n: str, block: int) -> tuple[Column, Column]:
    """Whether an anchor of ``n`` stretches has several blocks, and a stretch's block."""
    blocks = F.ceil(F.col(n) / block).cast("int")
    return (blocks > 1).alias("several"), F.when(blocks > 1, F.pmod(F.xxhash64("k", "mark", "first"), blocks)).otherwise(0).cast("int").alias("block")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, ladder: tuple[int, ...] = LADDER, block: int = BLOCK, run_bytes: int = RUN_BYTES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): each text's bytes without those that a repeated string of ``length`` bytes covers."""
    spark = docs.sparkSession
    ready_checkpoints(spark)
    bound_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    base = docs.select(F.xxhash64(F.col(id_col).cast("string"), text).alias("k"), (F.crc32(text) - (1 << 31)).cast("int").alias("mark"), F.col(id_col).alias("own"), text.alias("text"))
    long = base.filter(F.octet_length("text") >= length).select("k", "mark", "text")
    counts = long.mapInArrow(_counted(length, gram), "anchor bigint, n bigint, own boolean, texts bigint, place int").groupBy("anchor").agg(F.sum("n").alias("n"), F.max("own").alias("own"), F.try_sum("texts").alias("texts"), F.min("place").alias("place")).filter("n > 1 or own").select("anchor", "n", F.when(F.col("n") <= block, F.xxhash64("n", "texts", "place")).otherwise(F.col("anchor")).alias("goes"))
    listed = long.mapInArrow(_listed(length, gram), "anchor bigint, k bigint, mark int, first int, windows smallint")
    want = listed.join(counts, "anchor").select("k", "mark", F.struct(F.col("goes").alias("anchor"), *_blocks("n", block), "first", F.col("windows").cast("int").alias("windows")).alias("w")).groupBy("k", "mark").agg(F.collect_list("w").alias("wanted"))
    # Texts are shuffled once: both joins with them are left joins on the same keys.
    packed = base.mapInArrow(_squeezed, f"k bigint, mark int, own {kind}, text binary")
    pieces = packed.join(want, ["k", "mark"], "left").mapInArrow(_cut_out(length), _PIECE)
    found, sizes = [], (gram, *ladder, length)
    for step in range(1 << 20):
        together = pieces.repartition("anchor", "block").sortWithinPartitions("anchor", "block")
        told = stored(together.mapInArrow(_resolved(length, sizes[min(step + 1, len(sizes) - 1)], run_bytes, sizes[min(step, len(sizes) - 1)]), _TOLD))
        found.append(told.filter("bytes is null").select("k", "mark", "first", "windows"))
        left = told.filter("bytes is not null")
        counts = left.groupBy("anchor").agg(F.count("*").alias("n"), F.min("known").alias("all_known")).filter("n > 1 and not all_known")
        if counts.isEmpty():
            break
        pieces = left.join(counts.select("anchor", "n"), "anchor").select("anchor", *_blocks("n", block), "k", "mark", "first", "windows", "known", "bytes")
    ranges = reduce(DataFrame.unionByName, found).groupBy("k", "mark").agg(F.collect_list(F.struct("first", "windows")).alias("ranges"))
    cleaned = packed.join(ranges, ["k", "mark"], "left").mapInArrow(_remove(length), f"own {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
    return cleaned.withColumnRenamed("own", id_col)
