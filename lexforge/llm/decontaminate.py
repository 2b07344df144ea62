"""Benchmark decontamination: items that stand in documents up to a share of word edits.

Words are runs of ASCII letters and digits (in lower case) and of bytes beyond ASCII.  An item of
n words is found where some run of a document's words is within floor(n * EDITS) word insertions,
deletions and substitutions of it.

Items of more than ``SEGMENT`` words are cut into segments of like size.  Wherever an item is found,
at least one of its segments has no more than its own share of the edits, so segments are searched
for and items are verified.

Every place of a document begins a window of a segment's size.  Windows and segments pass a CGK
embedding: a random walk that copies a word and moves on or stays as a random bit of the word and
the step says, which turns edit distance into Hamming distance.  Windows of all sizes that begin at
one place share their walk, so it is taken once, ``WALKS`` times over.  A table samples a
few places of a walk; a window whose sample equals a segment's in some table is a candidate.  Segments
of like size share tables, whose places lie within the walks of the shortest of them; their number
(``CLASSES``) is chosen for a recall of 0.95 or more at the edit limit, which the tests measure.
Exact edit distance, with free ends in the window and its margins, decides on candidates: first of
the segment, then of the whole item.

No shuffle: items (in blocks of ``ITEM_BYTES``, so that what goes to the executors is bounded)
meet all documents in one pass over the texts a block.

Defined results: null and empty texts and items match nothing; repeated documents give repeated
rows, repeated items (one id) count once, the smallest distance of an id wins; ids may have any
type, rows with a null item id are left out; very long texts and items are worked on in pieces of
bounded size; empty tables give an empty result; other columns are not read by ``matches`` and come
along unchanged in ``clean``, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.shared import bound_batches, gives_back

EDITS, SEGMENT, WALKS, ITEM_BYTES = 0.2, 28, 4, 8 << 20
#: Least words of the segments that share tables, the number of these, and the places that each samples.  Below five words no edit is allowed, and one place finds them.
CLASSES = ((1, 1, 1), (5, 24, 3), (9, 36, 5), (17, 64, 5))
#: Words of windows that are compared at once.
REGION_WORDS = 1 << 20
_SEP = np.ones(256, bool)
_SEP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_FOLD = bv.fold_table({c: c + 32 for c in range(65, 91)})
_PAD = np.uint64(0)


def word_hashes(c: bv.Chunk) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = bv.words(c, _SEP)
    return c.hasher(_FOLD).of(starts, ends) | np.uint64(1), first


@dataclass
class Table:
    """A sample of a walk: its places, and for each place the words that segments have there (by 16 bits); samples of segments in order, with their segments."""

    walk: int
    places: tuple[int, ...]
    seen: list[np.ndarray]
    samples: np.ndarray
    segment: np.ndarray


def _odds(walk: int, steps: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1000 + walk)).integers(1, 1 << 30, steps, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def _steps(words: np.ndarray, walk: int, steps: int) -> Iterator[np.ndarray]:
    """CGK walks from every place of ``words`` (32 bits, zeros behind the last): the word of each walk, step by step."""
    at = np.arange(len(words))
    padded = np.concatenate([words, np.zeros(steps + 1, np.uint32)])
    for odd in _odds(walk, steps):
        word = padded.take(at, mode="clip")
        yield word
        word = word * odd
        word >>= np.uint32(31)
        at += word


def _sample(parts: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for x in parts:
        out = bv.mix(out ^ x.astype(np.uint64)) + np.uint64(1)
    return out


class Items:
    """A block of items, ready to be looked for."""

    def __init__(self, ids: list, words: list[np.ndarray], share: float):
        self.ids, self.words = ids, words
        self.size = np.array([len(w) for w in words], np.int64)
        self.edits = np.floor(self.size * share + 1e-9).astype(np.int64)
        parts = -(-self.size // SEGMENT)
        self.item = np.repeat(np.arange(len(words)), parts)
        nth = np.arange(len(self.item)) - np.repeat(np.cumsum(parts) - parts, parts)
        n = self.size[self.item]
        self.at = nth * n // parts[self.item]  # first word of each segment in its item
        self.length = (nth + 1) * n // parts[self.item] - self.at
        self.allowed = np.floor(self.length * share + 1e-9).astype(np.int64)
        flat = np.concatenate(words)
        begin = (np.cumsum(self.size) - self.size)[self.item] + self.at
        inside = np.arange(SEGMENT) < self.length[:, None]
        self.segments = np.where(inside, flat[np.minimum(begin[:, None] + np.arange(SEGMENT), len(flat) - 1)], _PAD)
        #: Which words each segment has, by ten bits of their hashes.
        self.has = np.zeros((len(self.item), 1024), bool)
        self.has[np.nonzero(inside)[0], (self.segments[inside] >> np.uint64(8)).astype(np.intp) & 1023] = True
        self.tables: list[Table] = []
        rng = np.random.Generator(np.random.PCG64(5))
        least = [c[0] for c in CLASSES]
        for c, (low, count, bits) in enumerate(CLASSES):
            mine = np.flatnonzero(np.searchsorted(least, self.length, "right") - 1 == c)
            reach = low + low // 2 if c else 1
            plans = [(k % WALKS, tuple(sorted(rng.choice(reach, min(bits, reach), replace=False).tolist()))) for k in range(count)]
            if len(mine):
                self._add(mine, plans, reach)
        self.reach = max(t.places[-1] for t in self.tables) + 1

    def _add(self, mine: np.ndarray, plans: list[tuple[int, tuple[int, ...]]], reach: int) -> None:
        # Segments stand apart by as many zeros as a walk may run on into.
        gap = SEGMENT + reach + 1
        rows = np.zeros((len(mine), gap), np.uint32)
        rows[:, :SEGMENT] = self.segments[mine] >> np.uint64(32)
        starts = np.arange(len(mine)) * gap
        walks = {w: np.stack([v[starts] for v in _steps(rows.ravel(), w, reach)]) for w in {p[0] for p in plans}}
        shown = {}
        for walk, p in {(w, p) for w, places in plans for p in places}:
            shown[walk, p] = np.zeros(1 << 16, bool)
            x = walks[walk][p]
            shown[walk, p][x[x != 0] >> np.uint32(16)] = True
        for walk, places in plans:
            parts = [walks[walk][p] for p in places]
            whole = np.flatnonzero(np.all([x != 0 for x in parts], 0))  # a walk that has left its segment says nothing
            if not len(whole):
                continue
            seen = [shown[walk, p] for p in places]
            sample = _sample([x[whole] for x in parts])
            order = np.argsort(sample)
            self.tables.append(Table(walk, places, seen, sample[order], mine[whole][order]))

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, segment) of all windows that agree with a segment in some table."""
        short = (words >> np.uint64(32)).astype(np.uint32)
        short[short == 0] = 1
        starts, segments = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for walk in sorted({t.walk for t in self.tables}):
            tables = [t for t in self.tables if t.walk == walk]
            due: dict[int, list[Table]] = {}
            for t in tables:
                for p in t.places:
                    due.setdefault(p, []).append(t)
            open_: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
            for p, word in enumerate(_steps(short, walk, max(due) + 1)):
                if p not in due:
                    continue
                key = (word >> np.uint32(16)).astype(np.intp)
                firsts: dict[int, np.ndarray] = {}  # tables that ask alike at their first place
                for t in due[p]:
                    seen = t.seen[t.places.index(p)]
                    if p == t.places[0]:
                        name = id(seen)
                        if name not in firsts:
                            firsts[name] = np.flatnonzero(seen.take(key, mode="clip"))
                        at, before = firsts[name], []
                    else:
                        at, before = open_.pop(id(t))
                        keep = seen.take(key.take(at, mode="clip"), mode="clip")
                        at, before = at[keep], [x[keep] for x in before]
                    before = [*before, word.take(at, mode="clip")]
                    if p != t.places[-1]:
                        open_[id(t)] = (at, before)
                    elif len(at):
                        sample = _sample(before)
                        lo, hi = np.searchsorted(t.samples, sample, "left"), np.searchsorted(t.samples, sample, "right")
                        starts.append(np.repeat(at, hi - lo))
                        segments.append(t.segment[bv.ragged(lo, hi - lo)])
        both = np.unique(np.concatenate(starts) * len(self.item) + np.concatenate(segments))
        return both // len(self.item), both % len(self.item)


def read_items(rows: list[tuple]) -> tuple[list, list[np.ndarray]]:
    """Ids and word hashes of the items that have words."""
    ids, words = [], []
    for c in bv.chunks(pa.array([t for _, t in rows], pa.string())):
        h, first = word_hashes(c)
        for i in range(c.hi - c.lo):
            if first[i + 1] > first[i]:
                ids.append(rows[c.lo + i][0])
                words.append(h[first[i] : first[i + 1]])
    return ids, words


def prepare(rows: list[tuple], share: float = EDITS) -> Items | None:
    ids, words = read_items(rows)
    return Items(ids, words, share) if ids else None


def distance(region: np.ndarray, item: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least edits between each item and any run of words of its region (rows padded by zeros, which match nothing)."""
    rows, width = region.shape
    best = np.zeros(rows, np.int64)
    row, col = np.zeros((rows, width + 1), np.int32), np.arange(width + 1, dtype=np.int32)
    for i in range(int(size.max())):
        e = np.empty_like(row)
        e[:, 0] = i + 1
        e[:, 1:] = np.minimum(row[:, :-1] + ((region != item[:, i : i + 1]) | (region == _PAD)), row[:, 1:] + 1)
        row = np.minimum.accumulate(e - col, 1) + col
        done = size == i + 1
        if done.any():
            best[done] = row[done].min(1)
    return best


def _regions(doc: np.ndarray, what: np.ndarray, lo: np.ndarray, hi: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, what, first word, end): stretches of words, cut at their documents' ends; those of one document that look for one thing and meet are one."""
    if not len(doc):
        return doc, what, lo, hi
    lo, hi = np.maximum(lo, first[doc]), np.minimum(hi, first[doc + 1])
    order = np.lexsort((lo, what, doc))
    doc, what, lo, hi = doc[order], what[order], lo[order], hi[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (what[1:] != what[:-1])
    far = (np.cumsum(fresh) - 1) * (int(first[-1]) + 1)
    upto = np.maximum.accumulate(hi + far) - far
    fresh[1:] |= lo[1:] > upto[:-1]
    a = np.flatnonzero(fresh)
    return doc[a], what[a], lo[a], upto[np.append(a[1:], len(doc)) - 1]


def _compared(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray, sought: list[np.ndarray] | np.ndarray, which: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Least edits between each region and what it is held against, regions of like size together so that padding stays small."""
    out = np.zeros(len(lo), np.int64)
    order = np.lexsort((hi - lo, size[which]))
    i = 0
    while i < len(order):
        j, widest = i, 0
        while j < len(order):
            widest = max(widest, int(hi[order[j]] - lo[order[j]]))
            if j > i and (j + 1 - i) * max(widest, int(size[which[order[j]]])) > REGION_WORDS:
                break
            j += 1
        r = order[i:j]
        n, k = hi[r] - lo[r], which[r]
        region = np.zeros((len(r), max(1, int(n.max()))), np.uint64)
        region[np.arange(region.shape[1]) < n[:, None]] = hashes[bv.ragged(lo[r], n)]
        wanted = np.zeros((len(r), int(size[k].max())), np.uint64)
        for row, x in enumerate(k.tolist()):
            wanted[row, : size[x]] = sought[x][: size[x]]
        out[r] = distance(region, wanted, size[k])
        i = j
    return out


def find(hashes: np.ndarray, first: np.ndarray, items: Items, exact_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, item, least edits) of all matches in these documents."""
    none = np.zeros(0, np.int64)
    if exact_only:  # whole documents against all items
        docs = np.flatnonzero(np.diff(first))
        doc, item = np.repeat(docs, len(items.words)), np.tile(np.arange(len(items.words)), len(docs))
        lo, hi = first[doc], first[doc + 1]
    else:
        start, segment = items.candidates(hashes)
        if not len(start):
            return none, none, none
        doc = np.searchsorted(first, start, "right") - 1
        margin = 2 * items.allowed[segment] + 1
        doc, segment, lo, hi = _regions(doc, segment, start - margin, start + items.length[segment] + margin, first)
        # A region with fewer of the segment's words than a match must have holds none.
        size = hi - lo
        known = items.has[np.repeat(segment, size), (hashes[bv.ragged(lo, size)] >> np.uint64(8)).astype(np.intp) & 1023]
        enough = np.add.reduceat(known.astype(np.int32), np.cumsum(size) - size) >= items.length[segment] - items.allowed[segment]
        doc, segment, lo, hi = doc[enough], segment[enough], lo[enough], hi[enough]
        if not len(doc):
            return none, none, none
        edits = _compared(hashes, lo, hi, items.segments, segment, items.length)
        ok = edits <= items.allowed[segment]
        doc, segment, lo, hi, edits = doc[ok], segment[ok], lo[ok], hi[ok], edits[ok]
        item = items.item[segment]
        whole = items.length[segment] == items.size[item]
        out = [np.stack([doc[whole], item[whole], edits[whole]], 1)]
        # Of items of several segments: where the item would stand around the segment that was found.
        doc, item, segment, lo, hi = doc[~whole], item[~whole], segment[~whole], lo[~whole], hi[~whole]
        margin, rest = 2 * items.edits[item], items.size[item] - items.at[segment] - items.length[segment]
        doc, item, lo, hi = _regions(doc, item, lo - items.at[segment] - margin, hi + rest + margin, first)
    edits = _compared(hashes, lo, hi, items.words, item, items.size)
    ok = edits <= items.edits[item]
    found = np.concatenate([*([] if exact_only else out), np.stack([doc[ok], item[ok], edits[ok]], 1)])
    name = {x: i for i, x in enumerate(items.ids)}
    same = np.array([name[x] for x in items.ids])[found[:, 1]]  # rows of one id are one item
    found = found[np.lexsort((found[:, 2], same, found[:, 0]))]
    same = np.array([name[x] for x in items.ids])[found[:, 1]]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, 0] != found[:-1, 0]) | (same[1:] != same[:-1])
    found = found[fresh]
    return found[:, 0], found[:, 1], found[:, 2]


_known: dict[str, Items] = {}


class _Block:
    """Items as they go to the executors: their words alone; each Python worker makes the tables of the block that it works on."""

    def __init__(self, ids: list, words: list[np.ndarray], share: float):
        self.name, self.ids, self.words, self.share = uuid.uuid4().hex, ids, words, share

    def items(self) -> Items:
        if self.name not in _known:
            _known.clear()
            _known[self.name] = Items(self.ids, self.words, self.share)
        return _known[self.name]


def _blocks(items: DataFrame, id_col: str, text_col: str, block_bytes: int, share: float) -> Iterator[_Block]:
    held, size = [], 0

    def block() -> Iterator[_Block]:
        ids, words = read_items(held)
        if ids:
            yield _Block(ids, words, share)

    for r in items.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, text_col).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1])
        if size >= block_bytes:
            yield from block()
            held, size = [], 0
    yield from block()


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS, exact_only: bool = False, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(id, item, edits, item_words): every item found in every document, with its least distance.

    ``exact_only`` compares whole documents with all items, to measure recall by.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("text"))
    kinds = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    ddl = f"d {kinds[0]}, item {kinds[1]}, edits bigint, item_words bigint"

    def finder(block: _Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block.items()
            for batch in batches:
                for c in bv.chunks(batch.column(1)):
                    d, k, e = find(*word_hashes(c), items, exact_only)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(c.lo + d)), pa.array([items.ids[i] for i in k.tolist()]), pa.array(e.astype(np.int64)), pa.array(items.size[k].astype(np.int64))], names=["d", "item", "edits", "item_words"])

        return run

    found = [rows.mapInArrow(gives_back(finder(b)), ddl) for b in _blocks(items, item_col, item_text, item_bytes, share)]
    out = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], ddl)
    if len(found) > 1:  # an item's rows may lie in several blocks
        out = out.groupBy("d", "item").agg(F.min("edits").alias("edits"), F.min("item_words").alias("item_words"))
    return out.select(F.col("d").alias(id_col), F.col("item").alias(item_col), "edits", "item_words")


def clean(docs: DataFrame, items: DataFrame, id_col: str = "item_id", item_text: str = "text", text_col: str = "text", share: float = EDITS, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The documents in which no item is found, with all their columns: one pass a block of items, no shuffle."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    names = [f"c{i}" for i in range(len(docs.columns))]
    ddl = ", ".join(f"`{n}` {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))

    def keeper(block: _Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = block.items()
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for c in bv.chunks(batch.column(at)):
                    keep[c.lo + find(*word_hashes(c), items)[0]] = False
                yield batch.filter(pa.array(keep))

        return run

    out = docs.toDF(*names)
    for block in _blocks(items, id_col, item_text, item_bytes, share):
        out = out.mapInArrow(gives_back(keeper(block)), ddl)
    return out.toDF(*docs.columns)
