"""How many members are near each other: exact counts by bit sets, where the pairs would be too many rows."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.operators.graphs import kept
from lexforge.operators.ranking import global_rank

#: Members that one task walks from, and links that are packed together.
BLOCK, LINKS = 8192, 1 << 18
#: Words of 64 starts that are walked at once, bytes of sets that a task holds, and of links before they go to a file.
WIDTH, SETS, HELD = 8, 128 << 20, 256 << 20
_CHUNK = "chunk bigint, low bigint, gaps binary, local binary, sizes binary"


def _packed(values: np.ndarray) -> bytes:
    """Numbers from 0 up in as few bytes each as the largest needs, after one byte that says how many."""
    size = next(k for k in (1, 2, 4, 8) if k == 8 or not len(values) or values.max() < 1 << 8 * k)
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def _plain(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1)


def _ids(low: int, gaps: bytes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(_plain(gaps).astype(np.uint64))]).astype(np.uint64).view(np.int64) + low


def _chunked(links: int):
    """Rows (grp, id) in order -> about ``links`` of them a row: their ids by the first and gaps, the links as places among these, and the groups' sizes."""

    def packed(chunk: int, ids: np.ndarray, fresh: np.ndarray) -> Iterator[pa.RecordBatch]:
        size = np.diff(np.append(np.flatnonzero(fresh), len(ids)))
        several = np.repeat(size > 1, size)  # who is alone in a group reaches nobody by it
        ids, size = ids[several], size[size > 1]
        if len(ids):
            ids, local = np.unique(ids, return_inverse=True)
            yield pa.RecordBatch.from_pydict({"chunk": [chunk], "low": [int(ids[0])], "gaps": [_packed(np.diff(ids).view(np.uint64))], "local": [_packed(local)], "sizes": [_packed(size)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size, last, last_id = TaskContext.get().partitionId() << 32, [], 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            grp, ids = batch.column(0), batch.column(1).to_numpy()
            fresh, new = np.ones(len(ids), bool), np.ones(len(ids), bool)
            fresh[1:] = pc.not_equal(grp[1:], grp[:-1]).to_numpy(zero_copy_only=False)
            fresh[0] = last is None or last != grp[0]
            new[1:] = ids[1:] != ids[:-1]
            new[0] = last_id != ids[0]
            last, last_id = grp[-1], ids[-1]
            new |= fresh
            ids, fresh = ids[new], fresh[new]
            heads = np.flatnonzero(fresh)
            if size + len(ids) >= links and len(heads):
                cut = heads[-1]
                held.append((ids[:cut], fresh[:cut]))
                yield from packed(chunk, *map(np.concatenate, zip(*held, strict=True)))
                chunk, held, size, ids, fresh = chunk + 1, [], 0, ids[cut:], fresh[cut:]
            held.append((ids, fresh))
            size += len(ids)
        if held:
            yield from packed(chunk, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> the ids that they name."""
    for batch in batches:
        for low, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            yield pa.RecordBatch.from_pydict({"id": _ids(low, gaps)})


def _blocks(bounds: list[int]):
    """Chunks -> the blocks of members that they name; bounds: each block's first id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, low, gaps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                blocks = np.unique(np.searchsorted(bounds, _ids(low, gaps), side="right") - 1)
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(blocks), chunk), "block": blocks})

    return run


class _Held:
    """Chunks of links to go through again and again: in memory, the rest in a file that is gone with the task."""

    def __init__(self, most: int):
        self.near, self.room, self.file, self.ids = [], most, None, np.zeros(0, np.int64)

    def add(self, low: int, *packed: bytes) -> None:
        self.ids = np.union1d(self.ids, _ids(low, packed[0]))
        self.room -= sum(map(len, packed))
        if self.room >= 0:
            self.near.append((low, *packed))
        else:
            self.file = self.file or tempfile.TemporaryFile()
            pickle.dump((low, *packed), self.file)

    def __iter__(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        yield from self.near
        if self.file:
            end = self.file.seek(0, 2)
            self.file.seek(0)
            while self.file.tell() < end:
                yield pickle.load(self.file)


def _heads(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def _united(sets: np.ndarray, of: np.ndarray, head: np.ndarray) -> np.ndarray:
    """The union of each run of sets: of is where they are, head where runs begin."""
    out = np.take(sets, of[head], axis=0)
    size = np.diff(np.append(head, len(of)))
    more = np.flatnonzero(size > 1)  # most runs are short; reduceat takes long for each run
    for nth in range(1, 4):
        if not len(more):
            return out
        out[more] |= np.take(sets, of[head[more] + nth], axis=0)
        more = more[size[more] > nth + 1]
    if len(more):
        left = np.repeat(np.isin(np.arange(len(head)), more), size)
        begin = np.cumsum(size[more]) - size[more]
        out[more] |= np.bitwise_or.reduceat(np.take(sets, of[left], axis=0), begin, axis=0)
    return out


def _step(chunks: Iterable[tuple[int, bytes, bytes, bytes]], ids: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """sets: for some words of starts, which of them reach each id.  Returns what they reach with one step more.

    A chunk passes on only what is new: of groups without a start nothing, and to members that hold
    all that its members hold nothing.
    """
    out = sets.copy()
    some = sets.any(2)
    every = np.bitwise_or.reduce(sets, axis=1)
    full = np.zeros(len(sets), bool)
    for low, gaps, local, sizes in chunks:
        if full.all():
            break
        rows = np.searchsorted(ids, _ids(low, gaps))
        local, sizes = _plain(local), _plain(sizes).astype(np.int64)
        by_id = np.argsort(local, kind="stable")
        local = local.astype(np.int64)
        group = np.repeat(np.arange(len(sizes)), sizes)
        group_of, degree = group[by_id], np.bincount(local, minlength=len(rows))
        member_of, first = np.repeat(np.arange(len(rows)), degree), np.cumsum(degree) - degree
        place = np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(~full):
            reached = np.flatnonzero(some[k][rows])
            if not len(reached):
                continue
            active = np.zeros(len(sizes), bool)
            dense = 4 * len(reached) >= len(rows)
            if not dense:
                n = degree[reached]
                link = np.repeat(first[reached] - np.cumsum(n) + n, n) + np.arange(n.sum())
                order = np.argsort(group_of[link], kind="stable")
                source, head = member_of[link][order], _heads(group_of[link][order])
                active[group_of[link]] = True
                to = np.flatnonzero(active[group_of])
            else:
                mine = np.take(sets[k], rows, axis=0)
                lacks = (np.bitwise_or.reduce(mine, axis=0) & ~np.take(out[k], rows, axis=0)).any(1)
                to = np.flatnonzero(lacks[member_of])
                if not len(to):
                    continue
                active[group_of[to]] = True
                source, n = local[active[group]], sizes[active]
                head = np.cumsum(n) - n
            of_group = np.bitwise_or.reduceat(np.take(sets[k], rows[source], axis=0), head, axis=0)
            place[active] = np.arange(len(of_group))
            member = member_of[to]
            head = _heads(member)
            new, at = _united(of_group, place[group_of[to]], head), rows[member[head]]
            new |= np.take(out[k], at, axis=0)
            out[k].view(f"V{new.itemsize * new.shape[1]}")[at, 0] = new.view(f"V{new.itemsize * new.shape[1]}")[:, 0]
            if dense:
                full[k] = not (every[k] & ~out[k]).any()
    return out


def _walked(depth: int, width: int = WIDTH, most_sets: int = SETS, most_held: int = HELD):
    """Rows of a block in order, its starts first and then the chunks that they may need -> how many each start reaches, itself included."""

    def walk(starts: np.ndarray, held: _Held) -> Iterator[pa.RecordBatch]:
        ids, at = held.ids, np.searchsorted(held.ids, starts)
        together = max(1, most_sets // max(1, len(ids) * width * 16)) * width * 64
        for low in range(0, len(at), together):
            mine = at[low : low + together]
            k, bit = np.divmod(np.arange(len(mine)), width * 64)
            sets = np.zeros((k[-1] + 1, len(ids), width), np.uint64)
            sets[k, mine, bit // 64] = np.uint64(1) << (bit % 64).astype(np.uint64)
            for _ in range(depth):
                sets = _step(held, ids, sets)
            n = np.zeros((len(sets), width * 64), np.int64)
            for x in range(0, len(ids), 4096):
                n += np.unpackbits(np.ascontiguousarray(sets[:, x : x + 4096]).astype("<u8").view(np.uint8), axis=2, bitorder="little").sum(1, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"id": starts[low : low + together], "n": n.ravel()[: len(mine)]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, held = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("ids", "low", "gaps", "local", "sizes")}
                if row["ids"].is_valid:
                    if held:
                        yield from walk(starts, held)
                    starts, held = row["ids"].values.to_numpy().copy(), _Held(most_held)
                else:
                    held.add(*(row[c].as_py() for c in ("low", "gaps", "local", "sizes")))
        if held:
            yield from walk(starts, held)

    return run


def reach_counts(links: DataFrame, depth: int, block: int = BLOCK, links_together: int = LINKS) -> DataFrame:
    """(start, reached): how many others are within ``depth`` steps of each member; a step leads to those that share a group with it.

    links: (id, grp); ids are whole numbers, repeated links count once, those with a null lead nowhere,
    and who reaches nobody has no row.  Links are packed in chunks, cut between groups, and members are
    dealt out in blocks, neighbours by id.  Each block gets the chunks that its members may reach in
    ``depth`` steps, at most all, and one task walks from all its members at once, in sets of bits that
    it alone holds: neither pairs nor sets are ever kept or sent, only packed links, once a block.
    """
    kind = links.schema["id"].dataType
    dealt = links.filter("id is not null and grp is not null").select("grp", F.col("id").cast("bigint").alias("id")).repartitionByRange("grp").sortWithinPartitions("grp", "id")
    chunks = kept(dealt.mapInArrow(_chunked(links_together), _CHUNK))
    ranked = global_rank(chunks.select("low", "gaps").mapInArrow(_named, "id bigint").distinct(), [F.col("id")], "pos")
    starts = kept(ranked.groupBy(F.expr(f"(pos - 1) div {block}").alias("block")).agg(F.array_sort(F.collect_list("id")).alias("ids")))
    bounds = [r["low"] for r in starts.select("block", F.element_at("ids", 1).alias("low")).orderBy("block").collect()]
    hit = kept(chunks.select("chunk", "low", "gaps").mapInArrow(_blocks(bounds), "chunk bigint, block bigint"))
    wanted = hit
    for _ in range(depth - 1):
        near = wanted.join(hit.toDF("chunk", "via"), "chunk").select("block", "via").distinct()
        wanted = near.join(hit.toDF("other", "via"), "via").select(F.col("other").alias("chunk"), "block").distinct()
    sent = chunks.join(wanted, "chunk").withColumn("ids", F.lit(None).cast("array<bigint>"))
    rows = starts.unionByName(sent, allowMissingColumns=True).repartitionById(max(1, len(bounds)), F.col("block").cast("int"))
    reached = rows.sortWithinPartitions("block", F.col("chunk").asc_nulls_first()).mapInArrow(_walked(depth), "id bigint, n bigint")
    return reached.filter("n > 1").select(F.col("id").cast(kind).alias("start"), (F.col("n") - 1).alias("reached"))
