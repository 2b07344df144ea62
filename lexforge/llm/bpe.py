"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Pre-tokens of the GPT-2 kind of pattern are found on whole byte buffers (runs of letters,
numbers, white space and the rest), once for each text.  A batch of documents is exploded into
positions, each of which holds the rank of its word among the batch's distinct words; batches are
shuffled once, compressed, and both readers share that exchange.  One sends the distinct words to
buckets by their hash.  A bucket holds every occurrence of a word, so each distinct word of the
corpus is merged once; its ids are joined back to the batches that asked, where the other reader
puts the documents together again by position.  Decoding joins the ids, position by position, with
the table of token bytes, which is broadcast (its size is checked) and keyed by place.

Words meet by their bytes, never by a hash alone.  A batch holds ``BATCH_BYTES`` of text or one
longer document, a bucket the words of ``BUCKET_BYTES`` of text: both grow in number with the
input, not in size.

Defined results: a null text is an empty one (no ids, empty bytes); repeated rows give repeated
rows; an empty table gives an empty result; a very long text is a batch of its own.  ``carry``
columns come along unchanged, and the columns ``ids`` and ``decoded`` are added under names of your
choice, which the carried columns must not have.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.shared import bound_batches, gives_back, partitions, text_bytes

#: Text of one batch (what one task holds while it reassembles documents), and text whose words make a bucket.
BATCH_BYTES, BUCKET_BYTES = 3 << 20, 24 << 20
#: Text whose batches one task puts together, one after another.
TASK_BYTES = 64 << 20
#: The most tokens of a vocabulary whose bytes may be broadcast.
MOST_TOKENS = 1_000_000
_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@functools.cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


@functools.cache
def merger(path: str):
    """One pre-token -> ids.  The library's own pattern takes the whole word, so only merges are left to do."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=load_ranks(path), special_tokens={}).encode_ordinary


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point, from the same Unicode properties as the pattern's."""
    out = np.zeros(0x110000, np.uint8)
    for props, kind in ((r"[\p{L}]", _LETTER), (r"[\p{N}]", _NUMBER), (r"[\p{White_Space}]", _SPACE)):
        for lo in range(0, 0x110000, 0x1000):
            if lo in range(0xD000, 0xE000, 0x1000):
                cps = [c for c in range(lo, lo + 0x1000) if not 0xD800 <= c < 0xE000]
            else:
                cps = list(range(lo, lo + 0x1000))
            for m in regex.finditer(props + "+", "".join(map(chr, cps))):
                out[cps[m.start()] : cps[m.end() - 1] + 1] = kind
    return out


def _byte_classes(buf: np.ndarray) -> np.ndarray:
    """Each byte's class: that of the character it belongs to."""
    table = _classes()
    kind = table[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        pad = np.concatenate([buf, np.zeros(3, np.uint8)]).astype(np.int32)
        a, b, c, d = pad[lead], pad[lead + 1] & 63, pad[lead + 2] & 63, pad[lead + 3] & 63
        two, three = a < 0xE0, a < 0xF0
        cp = np.where(two, (a & 31) << 6 | b, np.where(three, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
        k = table[np.minimum(cp, 0x10FFFF)]
        kind[lead], kind[lead + 1] = k, k
        kind[lead[~two] + 2] = k[~two]
        kind[lead[~three] + 3] = k[~three]
    return kind


def pretokens(c: bv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all matches of the pattern, and each document's first match (one more than documents)."""
    buf, offs, n = c.buf, c.offs, len(c.buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    kind = _byte_classes(buf)
    begins = np.empty(n, bool)
    begins[0], begins[1:] = True, kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins |= edge[:n]
    # A white-space run before other text gives up its last character: to the next run if it is a
    # plain space, else as a match of its own.
    runs = np.flatnonzero(begins)
    ends = np.append(runs[1:], n)
    gap = (kind[runs] == _SPACE) & ~edge[ends]
    last = ends[gap] - 1
    while len(move := np.flatnonzero((buf[last] & 0xC0) == 0x80)):
        last[move] -= 1
    begins[last] = True
    plain = last[buf[last] == 0x20]
    begins[plain + 1] = False
    # Contractions: an apostrophe that begins a match (no plain space before it in the same match).
    at = np.flatnonzero(buf == 0x27)
    if len(at):
        at = at[begins[at]]
        pad = np.concatenate([buf, np.zeros(2, np.uint8)])
        stop = offs[np.searchsorted(offs, at, "right")]
        x, y = pad[at + 1], pad[at + 2]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8)) & (at + 2 <= stop)
        two = (((x == 114) | (x == 118)) & (y == 101) | (x == 108) & (y == 108)) & (at + 3 <= stop)
        for hit, width in ((at[one], 2), (at[two], 3)):
            begins[hit + 1] = False
            if width == 3:
                begins[hit + 2] = False
            follow = hit + width
            follow = follow[follow < n]
            begins[follow[~edge[follow] & (kind[follow] == _LETTER)]] = True
    starts = np.flatnonzero(begins)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offs)


def _groups(batches: Iterator[pa.RecordBatch], at: int, limit: int) -> Iterator[pa.Table]:
    """Rows of this partition in groups of about ``limit`` bytes of column ``at``."""
    held, size = [], 0
    for batch in batches:
        offs = bv.buffers(batch.column(at))[1]
        lo = 0
        while lo < batch.num_rows:
            hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit - size, "right")) - 1))
            if held and size + offs[hi] - offs[lo] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(lo, hi - lo))
            size += int(offs[hi] - offs[lo])
            lo = hi
    if held:
        yield pa.Table.from_batches(held)


def _pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays of bytes, compressed together."""
    raw = [bytes(x) if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(raw), *map(len, raw)], np.int64).tobytes() + b"".join(raw))


def _unpack(data: bytes) -> list[memoryview]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(data))
    n = int.from_bytes(raw[:8], "little")
    cuts = np.cumsum([8 + 8 * n, *np.frombuffer(raw, np.int64, n, 8).tolist()]).tolist()
    return [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def distinct_strings(tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Of (bytes, starts, ends) of some buffers: each string's number among the distinct ones, and these one after another with their offsets.

    Strings are sorted by hash; those with equal hashes are compared byte by byte, and where any two
    differ the strings themselves are numbered.
    """
    hashes = [bv.Hasher(buf).of(s, e) for buf, s, e in tokens]
    every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    _, at, number = np.unique(every, return_index=True, return_inverse=True)
    cut = np.cumsum([0, *map(len, hashes)])
    numbers = [number[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    length = np.concatenate([e - s for _, s, e in tokens])[at] if tokens else np.zeros(0, np.int64)
    offs = np.concatenate([[0], np.cumsum(length)])
    data = np.zeros(int(offs[-1]), np.uint8)
    for (buf, s, _), a, b in zip(tokens, cut[:-1], cut[1:], strict=True):
        mine = np.flatnonzero((at >= a) & (at < b))
        data[bv.ragged(offs[mine], length[mine])] = buf[bv.ragged(s[at[mine] - a], length[mine])]
    for (buf, s, e), n in zip(tokens, numbers, strict=True):
        if not _same_bytes(buf, s, e, data, offs, n):
            return _by_bytes(tokens)
    return numbers, data, offs


def _same_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray, offs: np.ndarray, number: np.ndarray) -> bool:
    """Whether every string equals the one that its number stands for."""
    if ((end - start) != (offs[number + 1] - offs[number])).any():
        return False
    a, b = bv.Hasher(buf).lanes, bv.Hasher(data).lanes
    x, y, left = start, offs[number], end - start
    while len(x):
        unlike = (a[x] ^ b[y]) & bv.MASKS[np.minimum(left, 8)]
        if unlike.any():
            return False
        more = left > 8
        x, y, left = x[more] + 8, y[more] + 8, left[more] - 8
    return True


def _by_bytes(tokens: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(buf[a:b].tobytes(), len(known)) for a, b in zip(s.tolist(), e.tolist(), strict=True)], np.int64) for buf, s, e in tokens]
    return numbers, np.frombuffer(b"".join(known), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in known])]).astype(np.int64)


def _batch_name(n: int) -> int:
    """A number of this partition's n-th batch that no other has."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | n


_PACK = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("data", pa.binary())])
_PACK_DDL = "batch bigint, bucket int, data binary"


def _packs(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(cols, _PACK, strict=True)], schema=_PACK)


def _exploded(limit: int, text_at: int):
    """Documents -> a row a batch: carried columns, words a document, and the words by position, as ranks by frequency (a byte of each rank after another); and the distinct words in this order: lengths, bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, held in enumerate(_groups(batches, text_at, limit)):
            tokens, counts = [], [np.zeros(0, np.int64)]
            for c in bv.chunks(held.column("text")):
                starts, ends, first = pretokens(c)
                tokens.append((c.buf, starts, ends))
                counts.append(np.diff(first))
            numbers, data, offs = distinct_strings(tokens)
            number, n = np.concatenate([np.zeros(0, np.int64), *numbers]), len(offs) - 1
            frequent = np.argsort(-np.bincount(number, minlength=n), kind="stable")
            rank = np.empty(n, np.uint32)
            rank[frequent] = np.arange(n, dtype=np.uint32)
            planes = rank[number].astype("<u4").view(np.uint8).reshape(-1, 4)
            length, start = np.diff(offs)[frequent], offs[:-1][frequent]
            sink = pa.BufferOutputStream()
            carried = held.drop_columns(["text"])
            with pa.ipc.new_stream(sink, carried.schema) as w:
                w.write_table(carried)
            docs = _pack(sink.getvalue().to_pybytes(), np.concatenate(counts).astype(np.int64), *(planes[:, i] for i in range(4)))
            words = _pack(length.astype("<u4"), data[bv.ragged(start, length)])
            yield pa.RecordBatch.from_arrays([pa.array([_batch_name(k)], pa.int64()), pa.array([docs], pa.binary()), pa.array([words], pa.binary())], names=["batch", "docs", "words"])

    return run


def _words(pack: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's distinct words: bytes, starts, lengths and buckets."""
    sizes, data = _unpack(pack)
    length, data = np.frombuffer(sizes, "<u4").astype(np.int64), np.frombuffer(data, np.uint8)
    start = np.cumsum(length) - length
    return data, start, length, (bv.Hasher(data).of(start, start + length) % np.uint64(buckets)).astype(np.int32)


def _asked(buckets: int):
    """A batch -> a row for each bucket of its distinct words: lengths, bytes."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in (x for b in batches for x in b.column(b.schema.get_field_index("words")).to_pylist()):
            data, start, length, bucket = _words(pack, buckets)
            order = np.argsort(bucket, kind="stable")
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[order])) + 1, [len(order)]]).tolist()
            rows, size = [], 0
            for mine in (order[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True) if j > i):
                rows.append((key[0].as_py(), int(bucket[mine[0]]), _pack(length[mine].astype("<u4"), data[bv.ragged(start[mine], length[mine])])))
                size += len(rows[-1][2])
                if size > 4 << 20:
                    yield _packs(rows)
                    rows, size = [], 0
            if rows:
                yield _packs(rows)

    return run


def _merged(ranks_path: str):
    """A bucket's words, as the batches ask for them -> their counts of ids and ids; each distinct word is merged once."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, known = merger(ranks_path), {}
        for batch in batches:
            rows = []
            for name, bucket, pack in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes, data = _unpack(pack)
                at, ids = 0, []
                for s in np.frombuffer(sizes, "<u4").tolist():
                    w = bytes(data[at : at + s])
                    at += s
                    got = known.get(w)
                    if got is None:
                        got = known[w] = np.array(merge(w.decode()), "<u4").tobytes()
                    ids.append(got)
                rows.append((name, bucket, _pack(np.array(list(map(len, ids)), "<u4") // 4, b"".join(ids))))
            yield _packs(rows)

    return run


def _assembled(names: list[str], buckets: int):
    """A batch and its words' ids -> its documents with their ids in order of position."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        parts = [_unpack(x) for x in answers.sort_by("bucket").column("data").to_pylist()]
        asked = np.frombuffer(b"".join(x[0] for x in parts), "<u4").astype(np.int64)
        flat = np.frombuffer(b"".join(x[1] for x in parts), "<u4")
        del parts
        made = []
        for pack, words in zip(docs.column("docs").to_pylist(), docs.column("words").to_pylist(), strict=True):
            by_bucket = np.argsort(_words(words, buckets)[3], kind="stable")
            if len(by_bucket) != len(asked):
                raise RuntimeError("a batch and the answers to it don't agree")
            size, begin = np.empty(len(asked), np.int64), np.empty(len(asked), np.int64)
            size[by_bucket], begin[by_bucket] = asked, np.cumsum(asked) - asked
            carried, counts, *planes = _unpack(pack)
            first = np.concatenate([[0], np.cumsum(np.frombuffer(counts, np.int64))])
            word = np.stack([np.frombuffer(x, np.uint8) for x in planes], 1).reshape(-1).view("<u4")
            held, lo = pa.ipc.open_stream(carried).read_all(), 0
            while lo < held.num_rows:  # about a million positions at once
                hi = max(lo + 1, int(np.searchsorted(first, first[lo] + (1 << 20), "right")) - 1)
                w = word[first[lo] : first[hi]]
                upto = np.concatenate([[0], np.cumsum(size[w])])
                ids = flat[bv.ragged(begin[w], size[w])]
                raw = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(upto[first[lo : hi + 1] - first[lo]] * 4), pa.py_buffer(ids)])
                made.append(held.slice(lo, hi - lo).append_column("ids", raw.cast(pa.binary())))
                lo = hi
        return pa.concat_tables(made).select([*names, "ids"])

    return run


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), ids_col: str = "ids", batch_bytes: int = BATCH_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``carry`` columns plus the ids of each whole text, as little-endian unsigned 32-bit integers."""
    bound_batches(docs.sparkSession)
    size = text_bytes(docs, text_col)
    buckets = max(1, -(-size // bucket_bytes))
    # Tasks follow the input in number, whatever the session's setting.
    tasks = max(partitions(docs.sparkSession), -(-size // TASK_BYTES))
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)], F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    exploded = rows.mapInArrow(gives_back(_exploded(batch_bytes, len(names))), "batch bigint, docs binary, words binary").repartition(tasks, "batch")
    asked = exploded.groupBy("batch").applyInArrow(gives_back(_asked(buckets)), _PACK_DDL)
    answers = asked.repartition(max(tasks, buckets), "bucket").groupBy("bucket").applyInArrow(gives_back(_merged(ranks_path)), _PACK_DDL).withColumnRenamed("batch", "part")
    kinds = "".join(f"`{n}` {rows.schema[n].dataType.simpleString()}, " for n in names)
    whole = exploded.groupBy("batch").cogroup(answers.groupBy("part")).applyInArrow(gives_back(_assembled(names, buckets)), f"{kinds}`ids` binary")
    return whole.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], F.col("ids").alias(ids_col))


def token_bytes(ranks_path: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The table of token bytes: all pieces one after another, with each id's start and length (-1: no such token)."""
    ranks = load_ranks(ranks_path)
    if len(ranks) > MOST_TOKENS or max(ranks.values(), default=0) >= 2 * MOST_TOKENS:
        raise ValueError(f"a vocabulary of more than {MOST_TOKENS} tokens")
    length = np.full(max(ranks.values(), default=0) + 2, -1, np.int64)  # the last stands for ids beyond
    for piece, i in ranks.items():
        length[i] = len(piece)
    start = np.cumsum(np.maximum(length, 0)) - np.maximum(length, 0)
    return b"".join(sorted(ranks, key=ranks.__getitem__)), start, length


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns plus the bytes that the ids stand for; null ids give null, an id that the vocabulary lacks is an error."""
    bound_batches(encoded.sparkSession)
    table = encoded.sparkSession.sparkContext.broadcast(token_bytes(ranks_path))
    names = [f"c{i}" for i in range(len(encoded.columns))]
    rows = encoded.toDF(*names)
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, start, length = table.value
        data = np.frombuffer(data, np.uint8)
        for batch in batches:
            raw, offs = bv.buffers(batch.column(at))
            lo = 0
            while lo < batch.num_rows:
                hi = min(batch.num_rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + (2 << 20), "right")) - 1))
                ids = np.minimum(raw[offs[lo] : offs[hi]].view("<u4"), len(length) - 1)
                size = length[ids]
                if len(size) and size.min() < 0:
                    raise ValueError("no such token")
                upto = np.concatenate([[0], np.cumsum(size)])[(offs[lo : hi + 1] - offs[lo]) // 4]
                out = pa.Array.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(upto), pa.py_buffer(data[bv.ragged(start[ids], size)])])
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, out.cast(pa.binary())], names=[*names, "out"])
                lo = hi

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    out = rows.mapInArrow(gives_back(run), f"{kinds}out binary")
    return out.select(*[F.col(n).alias(c) for c, n in zip(encoded.columns, names, strict=True)], F.when(F.col(names[at]).isNotNull(), F.col("out")).alias(out_col))
