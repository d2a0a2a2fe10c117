"""WARC archives as a Python data source: files are planned as partitions, headers are read before payloads are decoded.

Records are gzip members of their own. The writer notes each member's compressed length in its header ('sl' extra
field), so a reader whose pushed predicates do not want a record seeks past it; members without that field are
inflated to find their end, and plain .warc records are passed over by their Content-Length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from barloom.llm._common import shared_dir

#: Column, header name. Predicates on these are decided from a record's header.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
}
SCHEMA = "record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_length long, payload binary, digest_ok boolean"
#: Bytes after which a task goes on in a new file, and that one read partition holds, about.
FILE_BYTES, PARTITION_BYTES = 128 << 20, 64 << 20
#: Date of records whose crawl time is not known (a fixed value, so that archives are reproducible).
DATE = "1970-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _filesystem(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path)


def record(kind: str, record_id: str, uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """A WARC/1.1 record. A revisit has the digest and length of the payload that it stands for, and no payload."""
    digest, length = sha1_base32(payload), len(payload)
    status = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = status + (payload if kind == "response" else b"")
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {length}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if uri:
        lines.insert(3, "WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to:
        lines += [f"WARC-Refers-To: <{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 4) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"sl" + struct.pack("<HII", 8, len(body) + 12 + 12 + 8, len(data) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_headers(head: bytes) -> dict[str, str]:
    found = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


class _Stream:
    """A file with a buffer in front."""

    def __init__(self, file):
        self.file, self.buffer = file, b""

    def fill(self, n: int) -> bytes:
        while len(self.buffer) < n and (more := self.file.read(max(1 << 16, n - len(self.buffer)))):
            self.buffer += more
        return self.buffer

    def skip(self, n: int) -> None:
        if n <= len(self.buffer):
            self.buffer = self.buffer[n:]
        else:
            self.file.seek(n - len(self.buffer), 1)
            self.buffer = b""


def records(file, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of the records whose headers wanted() takes; blocks of others are not decoded where avoidable."""
    s = _Stream(file)
    while s.fill(2):
        if s.buffer[:2] != b"\x1f\x8b":  # a plain record
            while b"\r\n\r\n" not in s.buffer:
                n = len(s.buffer)
                if len(s.fill(n + (1 << 16))) == n:
                    return
            head, _, _ = s.buffer.partition(b"\r\n\r\n")
            headers = parse_headers(head.lstrip())
            length = int(headers.get("content-length", 0))
            s.skip(len(head) + 4)
            if wanted(headers):
                yield headers, s.fill(length)[:length]
            s.skip(length)
            while s.fill(2)[:2] == b"\r\n":
                s.skip(2)
            continue
        s.fill(24)
        size = None
        if s.buffer[3] & 4 and s.buffer[12:14] == b"sl":
            size = struct.unpack("<I", s.buffer[16:20])[0]
            s.fill(min(size, 1 << 14))
        inflate, data = zlib.decompressobj(31), b""
        step = s.buffer if size is None else s.buffer[:size]
        taken = len(step)
        data = inflate.decompress(step, 8192)
        while b"\r\n\r\n" not in data and not inflate.eof:
            if inflate.unconsumed_tail:
                data += inflate.decompress(inflate.unconsumed_tail, 8192)
            else:
                n = taken
                if size is None:
                    s.fill(n + (1 << 16))
                    step = s.buffer[n:]
                else:
                    step = s.fill(min(size, n + (1 << 16)))[n:size]
                if not step:
                    break
                taken += len(step)
                data += inflate.decompress(step, 8192)
        head, _, block = data.partition(b"\r\n\r\n")
        headers = parse_headers(head)
        take = wanted(headers)
        if not take and size is not None:
            s.skip(size)
            continue
        parts = [block]
        while not inflate.eof:
            if inflate.unconsumed_tail:
                more = inflate.decompress(inflate.unconsumed_tail, 1 << 20)
            else:
                n = taken
                step = s.fill(n + (1 << 18) if size is None else min(size, n + (1 << 18)))[n : None if size is None else size]
                if not step:
                    break
                taken += len(step)
                more = inflate.decompress(step, 1 << 20)
            if take:
                parts.append(more)
        s.skip(size if size is not None else taken - len(inflate.unused_data))
        if take:
            yield headers, b"".join(parts)[: int(headers.get("content-length", 0))]


@dataclass
class _Files(InputPartition):
    files: list[str]


class _Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.tests: list[tuple[str, frozenset]] = []

    def pushFilters(self, filters):
        """Equality and membership over header columns are decided here; the rest goes back to Spark."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in HEADERS and column != "payload_length":
                self.tests.append((column, frozenset([f.value])))
            elif isinstance(f, In) and column in HEADERS and column != "payload_length":
                self.tests.append((column, frozenset(f.value)))
            else:
                yield f

    def partitions(self):
        fs, root = _filesystem(self.path)
        found = fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=False, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", ".")))
        plan, held = [], 0
        for name, size in files:
            if not plan or held + size > PARTITION_BYTES:
                plan.append(_Files([]))
                held = 0
            plan[-1].files.append(name)
            held += size
        return plan or [_Files([])]

    def _row(self, headers: dict[str, str], block: bytes) -> tuple:
        value = lambda c: headers.get(HEADERS[c])
        digest = (value("payload_digest") or "").rpartition(":")[2] or None
        payload, ok = None, None
        if self.payload:
            payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
            if value("record_type") != "revisit":
                ok = None if digest is None else sha1_base32(payload) == digest
            else:
                payload = None
        strip = lambda x: x and x.strip("<>")
        length = value("payload_length")
        return value("record_type"), strip(value("record_id")), value("target_uri"), strip(value("refers_to")), digest, int(length) if length else None, payload, ok

    def _wanted(self, headers: dict[str, str]) -> bool:
        row = dict(zip(HEADERS, self._row(headers, b""), strict=False)) if self.tests else {}
        return all(row[c] in values for c, values in self.tests)

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        rows: list[tuple] = []
        held = 0
        for name in partition.files:
            with fs.open_input_file(name) as file:
                for headers, block in records(file, self._wanted):
                    rows.append(self._row(headers, block))
                    held += len(block)
                    if held > 8 << 20 or len(rows) >= 5000:
                        yield _batch(rows)
                        rows, held = [], 0
        if rows:
            yield _batch(rows)


_TYPES = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_()]
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(_TYPES)], names=_NAMES)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    """Tasks write below _temporary under names of their own; the commit moves the files of the tasks that count.

    To overwrite is to delete the archive's files of before, once all new ones are written.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator):
        fs, root = _filesystem(self.path)
        fs.create_dir(f"{root}/_temporary", recursive=True)
        names, out, held = [], None, 0
        for b in iterator:
            for kind, rid, uri, refers, payload in zip(*(b.column(c).to_pylist() for c in ("record_type", "record_id", "target_uri", "refers_to", "payload")), strict=True):
                if out is None or held > FILE_BYTES:
                    if out:
                        out.close()
                    names.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, held = fs.open_output_stream(f"{root}/_temporary/{names[-1]}", compression=None), 0
                member = gzip_member(record(kind, rid, uri, refers, payload or b""))
                out.write(member)
                held += len(member)
        if out:
            out.close()
        return _Written(names)

    def commit(self, messages):
        fs, root = _filesystem(self.path)
        fs.create_dir(root, recursive=True)
        names = [name for m in messages if m for name in m.files]
        old = [f.path for f in fs.get_file_info(pyarrow.fs.FileSelector(root)) if f.is_file] if self.overwrite else []
        with ThreadPoolExecutor(16) as pool:  # renames, no data
            list(pool.map(lambda name: fs.move(f"{root}/_temporary/{name}", f"{root}/{name}"), names))
            list(pool.map(fs.delete_file, old))
        self.abort(messages)

    def abort(self, messages):
        fs, root = _filesystem(self.path)
        if fs.get_file_info(f"{root}/_temporary").type != pyarrow.fs.FileType.NotFound:
            fs.delete_dir(f"{root}/_temporary")


class WarcDataSource(DataSource):
    """format("warc"). Options: path; payload (default true): false leaves payload and digest_ok null and decodes headers alone."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    # the processes that plan a data source do not have the driver's module path, so the classes travel whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_archive(pages: DataFrame, path: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", mode: str = "append") -> None:
    """A record per row. Of equal payloads of least_bytes or more, the one of the largest id is the response and the others revisit it.

    A null payload is empty. A row of null id is always a response. Ids may repeat: each row is judged by its id and
    payload, and rows that repeat both are alike. mode "overwrite" replaces the archive at path.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("uri"), F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    digest = F.unhex(F.sha1("payload")).alias("digest")
    keyed = rows.where(F.octet_length("payload") >= least_bytes).select("id", digest)
    firsts = keyed.groupBy("digest").agg(F.max("id").alias("first"), F.count("*").alias("c")).where("c > 1")
    # one row a digest on this side: a payload that a third of all rows share can be split on the other
    revisits = keyed.join(firsts.select("digest", "first"), "digest").where("id <> first").distinct()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    # by id and digest: rows of one payload are spread by their ids
    records = rows.withColumn("digest", digest).join(revisits, ["id", "digest"], "left").select(
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"), urn("id").alias("record_id"), F.col("uri").alias("target_uri"),
        F.when(F.col("first").isNotNull(), urn("first")).alias("refers_to"), "payload",
    )
    register(pages.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def read_archive(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def archive_and_read(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to, verified.

    Responses are read with their payloads, whose lengths and digests are taken anew; revisits by their headers alone.
    """
    spark = pages.sparkSession
    path = shared_dir(spark)
    write_archive(pages, path, least_bytes)
    number = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).try_cast("long")
    full = read_archive(spark, path).where("record_type = 'response'")
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"), F.col("digest_ok").alias("verified"))
    light = read_archive(spark, path, payload=False).where("record_type = 'revisit'")
    light = light.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.lit(None).cast("boolean").alias("verified"))
    return full.union(light)
