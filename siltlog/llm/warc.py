"""WARC archives as a PySpark data source, and storing of pages with revisit records."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from siltlog.llm.shared import join_group, shared_path, stored

FIELDS = ["record_id string", "record_type string", "target_uri string", "date string", "payload_digest string", "refers_to string", "original_length long", "content_length long"]
SCHEMA = ", ".join([*FIELDS, "payload binary"])
HEADERS = {
    "record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To", "original_length": "WARC-Original-Payload-Length", "content_length": "Content-Length",
}
#: Each commit adds a manifest of its archives, so that appends add up.
MANIFEST = "_archives-"
#: Compressed bytes after which a read partition ends, at a record's edge.
SPLIT = 16 << 20
#: Repeated digests are sent to every executor up to this many (some 60 bytes each), else pages are shuffled by digest.
SENT_DIGESTS = 1_000_000


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI; a plain path is local."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path[5:])


def record(values: dict) -> bytes:
    """One WARC/1.1 record; values by the names of SCHEMA, absent ones are left out."""
    body = values.get("payload") or b""
    values = values | {"content_length": len(body)}
    lines = ["WARC/1.1", *(f"{h}: {clean(values[k])}" for k, h in HEADERS.items() if values.get(k) is not None)]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def clean(value) -> str:
    """A header value stays on its line."""
    return " ".join(str(value).split("\r")).replace("\n", " ") if isinstance(value, str) else str(value)


def headers(raw: bytes) -> dict[str, str]:
    """Header fields of a record by lower-cased name; folded lines are joined."""
    out, last = {}, None
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, _, value = line.partition(":")
            last = last.strip().lower()
            out[last] = value.strip()
    return out


@dataclass
class Span(InputPartition):
    path: str
    start: int
    end: int  # -1: to the end


@dataclass
class Written(WriterCommitMessage):
    name: str
    splits: list[int]


def member(data: bytes) -> bytes:
    """A gzip member whose header tells its own length in the `sl` extra field, so that readers can pass it by."""
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32:
        head = b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def member_length(head: bytes) -> int | None:
    """The length that the first bytes of a gzip member tell, if they do."""
    if len(head) < 24 or head[:3] != b"\x1f\x8b\x08" or not head[3] & 4 or head[12:16] != b"sl\x08\x00":
        return None
    return struct.unpack("<I", head[16:20])[0]


class WarcWriter(DataSourceArrowWriter):
    """Each task writes one archive, a gzip member for each record; the commit adds a manifest of the archives that count."""

    def __init__(self, path: str, fields: list[str]) -> None:
        self.path, self.fields, self.job = path, fields, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        name, at, last, splits = f"part-{self.job}-{uuid.uuid4().hex}.warc.gz", 0, 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None) as out:  # has its own gzip members
            for batch in iterator:
                columns = [batch.column(f) for f in self.fields]
                for k in range(batch.num_rows):
                    if at - last >= SPLIT:
                        splits.append(last := at)
                    data = member(record({f: c[k].as_py() for f, c in zip(self.fields, columns, strict=True)}))
                    out.write(data)
                    at += len(data)
        return Written(name, splits)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.path)
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{MANIFEST}{self.job}.json") as out:
            out.write(json.dumps({m.name: m.splits for m in messages if m}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        """Archives of this job go, also those of tasks that failed on the way."""
        store, root = file_system(self.path)
        for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"part-{self.job}-"):
                store.delete_file(f"{root}/{x.base_name}")


class WarcReader(DataSourceReader):
    def __init__(self, path: str, fields: list[str]) -> None:
        self.path, self.fields = path, fields
        self.equal: list[tuple[str, list]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality and membership on header fields are decided before a payload is touched."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute[0] != "payload":
                self.equal.append((f.attribute[0], [f.value]))
            elif isinstance(f, In) and f.attribute[0] != "payload":
                self.equal.append((f.attribute[0], list(f.value)))
            else:
                yield f

    def partitions(self) -> list[Span]:
        store, root = file_system(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Span(self.path, 0, -1)]
        base, found = self.path.rstrip("/"), {}
        names = [x.base_name for x in store.get_file_info(fs.FileSelector(root)) if x.is_file]
        manifests = [n for n in names if n.startswith(MANIFEST)]
        for name in manifests:
            with store.open_input_stream(f"{root}/{name}") as f:
                found |= json.loads(f.read())
        if not manifests:
            found = {n: [0] for n in names if n.endswith((".warc", ".warc.gz"))}
        return [Span(f"{base}/{name}", a, b) for name, at in sorted(found.items()) for a, b in zip(at, [*at[1:], -1], strict=True)] or [Span("", 0, 0)]

    def read(self, part: Span) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f, pa.int64() if f.endswith("length") else pa.binary() if f == "payload" else pa.string()) for f in self.fields])
        rows, size = [], 0
        for found, payload in records(part) if part.path else ():
            values = {}
            for k, h in HEADERS.items():
                v = found.get(h.lower())
                values[k] = v if v is None or not k.endswith("length") else int(v) if v.isdigit() else None
            wanted = all(values.get(k) in vs for k, vs in self.equal)
            body = payload(wanted and "payload" in self.fields)
            if wanted:
                rows.append([body if f == "payload" else values.get(f) for f in self.fields])
                size += len(body or b"")
            if size > 8_000_000 or len(rows) >= 5_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema, strict=True)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema, strict=True)], schema=schema)


class _Bytes:
    """The records of a run of gzip members, or of plain bytes, up to a compressed end (-1: of the file)."""

    def __init__(self, source, packed: bool, start: int, end: int) -> None:
        self.source, self.packed, self.end = source, packed, end
        self._seek(start)

    def _seek(self, place: int) -> None:
        self.source.seek(place)
        self.place, self.tail = place, b""  # `tail` has been read and ends at `place`
        self.inflate, self.next = None, None
        self.buffer, self.at = bytearray(), 0

    def _read(self, n: int) -> bytes:
        n = n if self.end < 0 else min(n, self.end - self.place)
        got = self.source.read(n) if n > 0 else b""
        self.place += len(got)
        return got

    def _more(self) -> bool:
        """Take in some bytes, a bounded number of them inflated."""
        if self.packed and self.inflate is None:  # a member begins
            while len(self.tail) < 24 and (got := self._read(1 << 16)):
                self.tail += got
            length = member_length(self.tail[:24])
            self.next = None if length is None else self.place - len(self.tail) + length
            self.inflate = zlib.decompressobj(31)
        self.tail = self.tail or self._read(1 << 16)
        if not self.tail:
            return False
        if not self.packed:
            self.buffer += self.tail
            self.tail = b""
            return True
        self.buffer += self.inflate.decompress(self.tail, 1 << 16)
        self.tail = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        if self.inflate.eof:
            self.inflate = None
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (k := self.buffer.find(mark, self.at)) < 0:
            if not self._more():
                return None
        out = bytes(self.buffer[self.at : k])
        self.at = k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        out = bytes(self.buffer[self.at : self.at + n])
        self.at += n
        self._trim()
        return out

    def skip(self, n: int) -> None:
        """Pass a payload by: where a member tells its length or bytes are plain, without reading it, else without keeping it."""
        left = n - (len(self.buffer) - self.at)
        if self.packed and self.inflate is not None and self.next is not None and left > 0:
            self._seek(self.next)  # a record is a member, so its end goes too
        elif not self.packed and left > 0:
            self._seek(self.place - len(self.tail) + left)
        else:
            while left > 0:
                self.at = len(self.buffer)
                self._trim(0)
                if not self._more():
                    return
                left -= len(self.buffer)
            self.at = len(self.buffer) + left

    def _trim(self, most: int = 1 << 20) -> None:
        if self.at > most:
            del self.buffer[: self.at]
            self.at = 0


def records(part: Span) -> Iterator[tuple[dict[str, str], callable]]:
    """Headers of each record and a function that takes its payload (None if it is not wanted)."""
    store, path = file_system(part.path)
    with store.open_input_file(path) as f:
        data = _Bytes(f, path.endswith(".gz"), part.start, part.end)
        while (head := data.until(b"\r\n\r\n")) is not None:
            if not head.strip():  # what parts records
                continue
            found = headers(head.lstrip(b"\r\n"))
            length = found.get("content-length", "0")
            n, taken = int(length) if length.isdigit() else 0, []

            def payload(keep: bool, n: int = n, taken: list = taken) -> bytes | None:
                taken.append(True)
                return data.take(n) if keep else data.skip(n)

            yield found, payload
            if not taken:
                data.skip(n)


class WarcSource(DataSource):
    """`spark.read.format("warc").load(path)` and `df.write.format("warc").mode("append").save(path)`.

    A path is an archive or a folder of archives (.warc, .warc.gz); a folder written here has a
    manifest, so leftovers of failed tasks are not read and large archives are read in parts.
    Ask for fewer columns with `.schema(...)`: without `payload` no payload is kept.
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema.fieldNames())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def digest(payload: F.Column) -> F.Column:
    """Bare upper-case base32 SHA-1: 160 bits are 32 digits of 5 bits."""
    hexed = F.sha1(payload)
    # 5 hexadecimal digits are 20 bits, and so 4 base32 digits
    groups = [F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    digits = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*[F.substring(digits, F.shiftright(g, 15 - 5 * j).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for g in groups for j in range(4)])


def write_pages(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> None:
    """Write a record per row: of rows with equal payloads of `least_bytes` or more, the largest id is the response.

    The others become revisit records, without a payload, that refer to it. Null html is an empty
    payload; a null url leaves the header out. A row without an id, and each further row of one id,
    is a response of its own. Only digests are grouped, and those that repeat are sent to where the
    pages are read, up to SENT_DIGESTS of them; html is never collected. Other columns are ignored.
    """
    register(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", digest(F.col("payload"))).withColumn("bytes", F.length("payload").cast("long"))
    groups = rows.filter(F.col("id").isNotNull() & (F.col("bytes") >= least_bytes)).groupBy("sha").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select(F.col("sha").alias("group"), "first")
    groups = stored(groups, "digests")
    rows = join_group(rows, groups, F.col("sha") == F.col("group"), SENT_DIGESTS, F.xxhash64("id", "url"))
    again = (F.col("first").isNotNull() & (F.col("bytes") >= least_bytes) & (F.col("id") < F.col("first"))).alias("again")
    rows = rows.withColumn("again", F.coalesce(again, F.lit(False)))

    def uri(c: str) -> F.Column:
        return F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))

    rows.select(
        uri("id").alias("record_id"),
        F.when(F.col("again"), "revisit").otherwise("response").alias("record_type"),
        F.col("url").alias("target_uri"),
        F.lit("1970-01-01T00:00:00Z").alias("date"),
        F.concat(F.lit("sha1:"), F.col("sha")).alias("payload_digest"),
        F.when(F.col("again"), uri("first")).alias("refers_to"),
        F.col("bytes").alias("original_length"),
        F.when(~F.col("again"), F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str, *, id_type: str = "bigint") -> DataFrame:
    """(id, target_uri, payload_bytes, payload_digest, record_type, refers_to, payload) of archives by `write_pages`.

    A response's size and digest are taken from its payload as read, a revisit's from its headers.
    """
    register(spark)

    def number(c: str) -> F.Column:
        return F.regexp_extract(c, r"^<urn:page:(.*)>$", 1)

    rows = spark.read.format("warc").load(path)
    whole = F.col("record_type") == "response"
    return rows.select(
        F.when(F.col("record_id").isNotNull(), number("record_id")).try_cast(id_type).alias("id"),
        "target_uri",
        F.when(whole, F.coalesce(F.length("payload"), F.lit(0)).cast("long")).otherwise(F.col("original_length")).alias("payload_bytes"),
        F.when(whole, digest(F.coalesce("payload", F.lit(b"")))).otherwise(F.regexp_replace("payload_digest", "^sha1:", "")).alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), number("refers_to")).try_cast(id_type).alias("refers_to"),
        "payload",
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_pages(spark, path).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


#: DuckDB has no base32, so the 160 bits are cut by hand.
OP9_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS sha FROM p),
g AS (SELECT sha, max(page_id) AS first FROM h GROUP BY sha),
d AS (SELECT sha, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(((CAST(('0x' || substr(sha, CAST(k // 4 * 5 + 1 AS INT), 5)) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT) + 1, 1)), '') AS digest FROM g)
SELECT h.page_id, payload_bytes, digest AS payload_digest, CASE WHEN h.page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN h.page_id <> first THEN first END AS refers_to FROM h JOIN g ON h.sha = g.sha JOIN d ON h.sha = d.sha
"""
