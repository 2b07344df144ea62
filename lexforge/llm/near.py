"""N-gram Jaccard join by MinHash banding.

Texts are sets of n-word shingles (words are runs without ASCII white space).  ``BANDS`` bands of
``ROWS`` minima each find a pair of similarity s with probability 1 - (1 - s**ROWS)**BANDS: 0.998
at 0.8.  One representative of each distinct text is banded; bands are shuffled by value; texts
that share a band value are compared on their full shingle sets, each pair once, in the group of
the first band that they share.  Bands with the same members make one group.  A group above
``BLOCK`` texts is cut into blocks that meet pairwise, so a task never holds more than two blocks,
and a task tells only its texts' counts of links and a spanning forest, never all pairs.

Defined results: a null text counts as an empty one; a text without words has no shingles and no
link; one of fewer than n words is a single shingle of all its words; repeated rows and equal
texts share a class; ties go to the smallest id; rows whose id is null come back with a null class
and no links; an empty table gives an empty result; ids must be whole numbers (other kinds are an
error), very long texts are compared like any other.  Only the id and text columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.llm import bytesview as bv
from lexforge.llm.shared import bound_batches, gives_back, ready_checkpoints
from lexforge.operators.components import connected_components

WORDS, SIMILAR, BANDS, ROWS, BLOCK = 5, (4, 5), 16, 5, 256


def shingles(c: bv.Chunk, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = bv.words(c)
    return bv.grams(c.hasher().of(starts, ends), first, n)


def text_key(text: str) -> Column:
    """Equal texts, null and empty ones included, have equal keys."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _signer(n: int, bands: int, rows: int):
    odd = np.random.Generator(np.random.PCG64(bands * 1000 + rows)).integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    salt = bv.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((batch.num_rows, bands), np.uint64)
            some = np.zeros(batch.num_rows, bool)
            for c in bv.chunks(batch.column(2)):
                h, first = shingles(c, n)
                has = np.flatnonzero(np.diff(first) > 0)
                if not len(has):
                    continue
                least = np.empty((bands * rows, len(has)), np.uint64)
                for i, a in enumerate(odd):
                    least[i] = np.minimum.reduceat(h * a, first[has])
                for b in range(bands):
                    out[c.lo + has, b] = bv.spans(least[b * rows : (b + 1) * rows].T.ravel(), rows)[::rows] ^ salt[b]
                some[c.lo + has] = True
            held = pa.ListArray.from_arrays(pa.array((np.arange(batch.num_rows + 1) * bands).astype(np.int32)), pa.array(bv.mix(out).view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), held], names=["key", "id", "bands"]).filter(pa.array(some))

    return run


def _compare(n: int, bands: int, similar: tuple[int, int], pairs: bool):
    """Rows (group, left, right, band, block, id, bands, text), a group's together -> (id, other, links[, shared, either])."""

    def group(rows: pa.Table) -> list[np.ndarray]:
        firsts: dict = {}
        for i, k in enumerate(zip(rows.column("id").to_pylist(), rows.column("key").to_pylist(), strict=True)):
            firsts.setdefault(k, i)
        if len(firsts) < rows.num_rows:  # repeated rows of the input
            rows = rows.take(pa.array(sorted(firsts.values())))
        ids = rows.column("id").to_numpy()
        block, band = rows.column("block").to_numpy(), rows.column("band")[0].as_py()
        cross = rows.column("left")[0].as_py() != rows.column("right")[0].as_py()
        sig = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)
        hs, docs, at = [], [], 0
        for c in bv.chunks(rows.column("text")):
            h, first = shingles(c, n)
            hs.append(h)
            docs.append(c.lo + np.repeat(np.arange(c.hi - c.lo), np.diff(first)))
        h, d = np.concatenate(hs), np.concatenate(docs)
        order = np.lexsort((d, h))
        h, d = h[order], d[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[fresh], d[fresh]
        size = np.bincount(d, minlength=len(ids))
        begins = np.ones(len(h), bool)
        begins[1:] = h[1:] != h[:-1]
        col = np.cumsum(begins) - 1
        many = np.bincount(col)[col] > 1
        d, col = d[many], np.unique(col[many], return_inverse=True)[1] if many.any() else col[:0]
        both = np.zeros((len(ids), len(ids)), np.float32)
        width = int(col[-1]) + 1 if len(col) else 0
        for lo in range(0, width, 8192):
            i, j = np.searchsorted(col, [lo, lo + 8192])
            m = np.zeros((len(ids), min(8192, width - lo)), np.float32)
            m[d[i:j], col[i:j] - lo] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        either = size[:, None] + size[None] - both
        linked = np.triu(both * similar[1] >= either * similar[0], 1) & (both > 0)
        if cross:
            linked &= block[:, None] != block[None]
        a, b = np.nonzero(linked)
        mine = (sig[a] == sig[b]).argmax(1) == band if len(a) else np.zeros(0, bool)
        a, b = a[mine], b[mine]
        if pairs:
            return [ids[a], ids[b], np.ones(len(a), np.int64), both[a, b], either[a, b]]
        links = np.bincount(a, minlength=len(ids)) + np.bincount(b, minlength=len(ids))
        root = np.arange(len(ids))
        while len(a):
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
        has = np.flatnonzero(links)
        return [ids[has], ids[root[has]], links[has]]

    names = ["id", "other", "links", "shared", "either"][: 5 if pairs else 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = [], None

        def flush(tables):
            got = group(pa.Table.from_batches(tables))
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in got], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                this = tuple(key[lo])
                if known is not None and this != known:
                    yield flush(held)
                    held = []
                held.append(batch.slice(lo, hi - lo))
                known = this
        if held:
            yield flush(held)

    return run, ", ".join(f"{x} bigint" for x in names)


def representatives(docs: DataFrame, id_col: str, text_col: str, n: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(key, id, bands) of the smallest id of each distinct text that has words."""
    keyed = docs.filter(F.col(id_col).isNotNull() & (F.length(text_col) > 0)).select(text_key(text_col).alias("key"), F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = keyed.mapInArrow(gives_back(_signer(n, bands, rows)), "key binary, id bigint, bands array<bigint>")
    return signed.groupBy("key").agg(F.min("id").alias("id"), F.first("bands").alias("bands"))


def compared(docs: DataFrame, id_col: str, text_col: str, n: int, similar: tuple[int, int], bands: int, rows: int, block: int, pairs: bool) -> DataFrame:
    spark = docs.sparkSession
    ready_checkpoints(spark)
    bound_batches(spark)
    reps = representatives(docs, id_col, text_col, n, bands, rows).checkpoint()
    dealt = reps.select("id", F.posexplode("bands").alias("band", "value"))
    found = dealt.groupBy("value").agg(F.min("band").alias("band"), F.count("*").alias("n"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")).filter("n > 1")
    groups = found.groupBy("n", "who").agg(F.min(F.struct("band", "value")).alias("g")).select("g.band", "g.value", "n")
    blocks = F.ceil(F.col("n") / block).cast("int")
    members = dealt.drop("band").join(groups, "value").select("value", "band", "id", blocks.alias("blocks"), F.pmod(F.xxhash64("id", "value"), blocks).cast("int").alias("block"))
    members = members.select("value", "band", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), text_key(text_col).alias("key"), F.col(text_col).alias("text"))
    full = members.join(reps, "id").join(texts, ["id", "key"])
    run, ddl = _compare(n, bands, similar, pairs)
    keys = ["value", "left", "right"]
    cut = full.select("value", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "band", "block", "id", "key", "bands", "text")
    return cut.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(gives_back(run), ddl)


def jaccard_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """The pairs themselves, between representatives of distinct texts: (a, b, shared, either)."""
    out = compared(docs, id_col, text_col, n, similar, bands, rows, block, True)
    return out.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), "shared", "either")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, similar: tuple[int, int] = SIMILAR, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row a document: its id, ``text_class`` (smallest id with an equal text), ``class_id`` (smallest id that links lead to) and ``n_links`` (other texts that are similar)."""
    told = compared(docs, id_col, text_col, n, similar, bands, rows, block, False).checkpoint()
    links = told.groupBy("id").agg(F.sum("links").alias("n_links"))
    roots = connected_components(told, "id", "other")
    keyed = docs.select(F.col(id_col), text_key(text_col).alias("key"))
    classes = keyed.filter(F.col(id_col).isNotNull()).groupBy("key").agg(F.min(id_col).cast("bigint").alias("text_class"))
    facts = classes.join(links.join(roots, "id", "left").withColumnRenamed("id", "text_class"), "text_class", "left")
    out = keyed.join(facts, "key", "left")
    known = F.col(id_col).isNotNull()
    return out.select(id_col, F.when(known, F.col("text_class")).alias("text_class"), F.when(known, F.coalesce("root", "text_class")).alias("class_id"), F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"))


def oracle(n: int = WORDS, similar: tuple[int, int] = SIMILAR) -> str:
    """jaccard_join of ``documents`` by all pairs that share a shingle, as SQL."""
    return rf"""
with recursive c as (select coalesce(text, '') as text, min(doc_id) as rep from documents group by 1),
w as (select rep, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from c),
s as (select rep, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < {n} then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i : i + {n - 1}], ' ')) end)) as s from w),
m as (select rep, count(*) as m from s group by 1),
p as (select a.rep as a, b.rep as b, count(*) as k from s a join s b on a.s = b.s and a.rep < b.rep group by all),
l as (select a, b from p join m x on x.rep = a join m y on y.rep = b where {similar[1]} * k >= {similar[0]} * (x.m + y.m - k)),
e as (select a, b from l union all select b, a from l),
r(node, root) as (select rep, rep from c union select e.b, r.root from r join e on e.a = r.node),
g as (select node, min(root) as root from r group by 1),
k as (select a, count(*) as n_links from e group by 1)
select doc_id, rep as text_class, root as class_id, coalesce(n_links, 0) as n_links from documents join c on c.text = coalesce(documents.text, '') join g on g.node = rep left join k on k.a = rep"""
