"""WARC derivatives: each response record becomes a metadata record and a plain-text conversion record.

Both refer to the response (WARC-Refers-To), keep its target, date and payload digest, and have
ids that derive from the response's id, so that a rerun writes the same records.  The metadata
block lists the source's status, headers and what the page says of itself (title, language,
links); the conversion block is the visible text.  Deriving is built-in functions: no shuffle.
``read_warc`` and ``write_warc`` read and write the files themselves.

Defined results: a null payload is an empty one (its digest is that of no bytes, its text is
empty); null targets and dates give records without that header; repeated responses give repeated
records; an empty table gives an empty result; a very long payload is one value like any other; only
the named columns are read, and ``carry`` must not have the names of the columns added.
"""

from __future__ import annotations

import gzip
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Named characters that conversion decodes; the ampersand comes last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&amp;", "&")]
_HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<title\b[^>]*>.*?</title\s*>|<!--.*?-->"
_BLOCK = r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|table|article|section|nav|footer|header|body|html|head)\b[^>]*>"
_TAG = r"<[^>]*>"
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LANG = r"""(?i)<html\b[^>]*\blang=["']?([a-z-]+)"""
_LINK = r"""(?i)<a\b[^>]*\bhref="""


def _decoded(c: Column) -> Column:
    for name, char in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(char))
    return c


def plain_text(html: Column) -> Column:
    """Visible text: lines at block tags, runs of blanks as one, no empty lines."""
    c = F.regexp_replace(html, _HIDDEN, " ")
    c = F.regexp_replace(F.regexp_replace(c, r"[\r\n]+", " "), _BLOCK, "\n")
    c = _decoded(F.regexp_replace(c, _TAG, ""))
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r" ?\n[ \n]*", "\n")
    return F.regexp_replace(c, r"^[ \n]+|[ \n]+$", "")


def record_id(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Response records of raw pages; ``page_id`` comes along."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"))
    return pages.select("page_id", record_id(F.lit("response"), F.col("page_id").cast("string"), "url").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"), head.alias("http_header"), payload.alias("payload"))


def header_fields(http_header: Column) -> Column:
    """The source's status line and one field a header, in order and as written; folded lines are joined."""
    lines = F.filter(F.split(F.regexp_replace(F.coalesce(http_header, F.lit("")), r"(\r\n|\r|\n)[ \t]+", " "), r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    named = F.transform(lines, lambda x, i: F.concat(F.when((i == 0) & x.startswith("HTTP/"), "sourceStatusLine: ").otherwise("sourceHeader: "), x, F.lit("\r\n")))
    return F.array_join(named, "")


def derivatives(records: DataFrame, carry: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Two rows a response (record_id, target_uri, date, http_header, payload): the records' headers and blocks."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = records.select(*carry, F.col("record_id").alias("refers_to"), "target_uri", "date", "http_header", payload.alias("payload"), digest(payload).alias("source_digest"))
    title = _decoded(F.trim(F.regexp_replace(F.regexp_extract("payload", _TITLE, 1), r"\s+", " ")))
    status = F.regexp_extract("http_header", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    fields = F.concat(F.lit("fetchStatus: "), status, F.lit("\r\nsourceContentType: "), F.trim(F.regexp_extract("http_header", r"(?i)content-type:([^\r\n]*)", 1)), F.lit("\r\nsourceDigest: "), F.col("source_digest"), F.lit("\r\ntitle: "), title, F.lit("\r\nlanguage: "), F.regexp_extract("payload", _LANG, 1), F.lit("\r\noutlinkCount: "), F.size(F.regexp_extract_all("payload", F.lit(_LINK), F.lit(0))).cast("string"), F.lit("\r\n"), header_fields(F.col("http_header")))
    both = base.select("*", F.inline(F.array(F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")), F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), plain_text(F.col("payload")).alias("block")))))
    return both.select(*carry, "warc_type", record_id("warc_type", "refers_to").alias("record_id"), "refers_to", "target_uri", "date", "source_digest", "content_type", F.octet_length("block").cast("bigint").alias("content_length"), digest(F.col("block")).alias("block_digest"), "block")


def record_text(rows: DataFrame) -> DataFrame:
    """One column, ``value``: whole WARC/1.1 records but for the closing blank lines."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit("\r\n")), F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("source_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length").cast("string")), F.lit("\r\n"))
    return rows.select(F.concat(head, F.col("block")).alias("value"))


_MADE = "file string, records bigint"


def write_warc(rows: DataFrame, path: str) -> int:
    """Compressed WARC files, a gzip member a record, as many as the rows have partitions; the number of records.

    ``path`` is a folder that driver and executors share, as a path or a URI that pyarrow knows.  A
    task writes under a name of its own attempt; files of attempts that didn't count are removed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get()
        files, folder = pafs.FileSystem.from_uri(path)
        name, n = f"part-{at.partitionId():05d}-{at.taskAttemptId()}.warc.gz", 0
        with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in batches:
                for value in batch.column(0):
                    out.write(gzip.compress(value.as_buffer().to_pybytes() + b"\r\n\r\n", 6, mtime=0))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "records"])

    files, folder = pafs.FileSystem.from_uri(path)
    files.create_dir(folder, recursive=True)
    made = {r["file"]: r["records"] for r in record_text(rows).select(F.col("value").cast("binary").alias("value")).mapInArrow(run, _MADE).collect()}  # a row a file
    for f in files.get_file_info(pafs.FileSelector(folder)):
        if f.base_name.endswith(".warc.gz") and f.base_name not in made:
            files.delete_file(f.path)
    return sum(made.values())


_FIELDS = ("warc_type", "record_id", "refers_to", "target_uri", "date", "block_digest", "source_digest", "content_type")
_NAMES = ("warc-type", "warc-record-id", "warc-refers-to", "warc-target-uri", "warc-date", "warc-block-digest", "warc-source-payload-digest", "content-type")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a WARC file, compressed by record or not: headers by lower-case name, and blocks."""
    raw, left = [], data
    while left[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        raw.append(member.decompress(left))
        left = member.unused_data
    at, data = 0, b"".join([*raw, left])
    while True:
        at = data.find(b"WARC/", at)
        if at < 0:
            return
        end = data.index(b"\r\n\r\n", at)
        head = re.sub(r"\r\n[ \t]+", " ", data[at:end].decode("utf-8", "replace")).split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in head if ":" in x)}
        size = int(fields.get("content-length", 0))
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files (up to 2 GB each, one task a file): named fields, http_header and payload of responses (null of others), block.

    A response's header ends at the first empty line; payload bytes that aren't UTF-8 are replaced.
    """
    ddl = ", ".join(f"{f} string" for f in _FIELDS) + ", http_header string, payload string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in ddl.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in parse_records(content.as_py()):
                    head, _, body = block.partition(b"\r\n\r\n") if fields.get("warc-type") == "response" else (None, None, None)
                    rows.append((*(fields.get(n) for n in _NAMES), head and head.decode("utf-8", "replace"), None if body is None else body.decode("utf-8", "replace"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "block" else pa.string()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "block" else pa.string()) for n, x in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, ddl)


def oracle() -> str:
    def decoded(x: str) -> str:
        for name, char in ENTITIES:
            name, char = name.replace("'", "''"), char.replace("'", "''")
            x = f"replace({x}, '{name}', '{char}')"
        return x

    sub = lambda x, pattern, to: "regexp_replace({}, '{}', {}, 'g')".format(x, pattern.replace("'", "''"), to)
    text = sub("payload", _HIDDEN, "' '")
    text = sub(sub(text, r"[\r\n]+", "' '"), _BLOCK, "chr(10)")
    text = sub(sub(decoded(sub(text, _TAG, "''")), r"[ \t]+", "' '"), r" ?\n[ \n]*", "chr(10)")
    text = sub(text, r"^[ \n]+|[ \n]+$", "''")
    title = decoded("trim(" + sub(f"regexp_extract(payload, '{_TITLE}', 1)", r"\s+", "' '") + ")")
    lang, link = _LANG.replace("'", "''"), _LINK
    uuid = lambda x: f"'<urn:uuid:' || regexp_replace(md5({x}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') || '>'"
    crlf = "chr(13) || chr(10)"
    of_source = f" || 'sourceStatusLine: HTTP/1.1 200 OK' || {crlf} || 'sourceHeader: Content-Type: text/html; charset=utf-8' || {crlf} || 'sourceHeader: Content-Length: ' || strlen(payload) || {crlf}"
    return f"""
with r as (select page_id, url, coalesce(html, '') as payload, {uuid("concat_ws('|', 'response', cast(page_id as varchar), url)")} as refers_to from pages),
d as (select *, 'sha256:' || sha256(payload) as source_digest from r),
b as (select *, 'metadata' as warc_type, 'application/warc-fields' as content_type,
  'fetchStatus: 200' || {crlf} || 'sourceContentType: text/html; charset=utf-8' || {crlf} || 'sourceDigest: ' || source_digest || {crlf} || 'title: ' || {title} || {crlf} || 'language: ' || regexp_extract(payload, '{lang}', 1) || {crlf} || 'outlinkCount: ' || len(regexp_extract_all(payload, '{link}')) || {crlf}{of_source} as block from d
  union all select *, 'conversion', 'text/plain; charset=utf-8', {text} from d)
select page_id, warc_type, {uuid("concat_ws('|', warc_type, refers_to)")} as record_id, refers_to, url as target_uri, '2024-01-01T00:00:00Z' as date, source_digest, content_type, cast(strlen(block) as bigint) as content_length, 'sha256:' || sha256(block) as block_digest, block from b"""
