"""WARC archives as a Spark data source.

`spark.read.format("warc")` plans a partition for each file, takes predicates on record type and header columns, parses a
record's headers first and inflates its payload only if the record passes and payloads are asked for (option payload=true).
Records are gzip members; members that this writer made carry their compressed length in the gzip extra field `sl`
(skip-length, WARC annex on gzip), so unwanted payloads are stepped over without being inflated. Archives of other writers
are read by inflating each member.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .token_store import open_fs

READ_SCHEMA = "record_type string, record_id string, target_uri string, date string, page_id string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "page_id": "X-Page-Id", "refers_to": "X-Refers-To-Page-Id"}
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL namespace of RFC 4122


def record_id(page_id, url: str | None = None) -> str:
    """A null page_id has a name by its url."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'url:{url}' if page_id is None else f'page:{page_id}')}>"


def member(head: bytes, body: bytes) -> bytes:
    """A gzip member of head and body whose extra field gives its own length and that of its content."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = z.compress(head) + z.compress(body) + z.flush()
    size, total = len(head) + len(body), 10 + 2 + 12 + len(data) + 8
    extra = b"sl" + struct.pack("<HII", 8, total & 0xFFFFFFFF, size & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + data + struct.pack("<II", zlib.crc32(body, zlib.crc32(head)), size & 0xFFFFFFFF)


def record(page_id, url: str | None, html: str | None, kind: str, refers_to, digest: str, n: int, date: str) -> bytes:
    """kind response: the page's payload; revisit: headers alone, naming the record whose payload is equal."""
    block = HEAD % n + ((html or "").encode() if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines += [f"X-Payload-Length: {n}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return member(("\r\n".join(lines) + "\r\n\r\n").encode(), block + b"\r\n\r\n")


class Source:
    """Buffered bytes of a file, with a way to step over some."""

    def __init__(self, file):
        self.file, self.buf, self.at = file, b"", 0

    def need(self, n: int) -> bytes:
        if len(self.buf) - self.at < n:
            self.buf = self.buf[self.at :] + self.file.read(max(n, 1 << 18))
            self.at = 0
        return self.buf[self.at : self.at + n]

    def skip(self, n: int) -> None:
        have = len(self.buf) - self.at
        if n <= have:
            self.at += n
        else:
            self.file.seek(self.file.tell() + n - have)
            self.buf, self.at = b"", 0


def records(file, wanted) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of each record; block is None, and is not inflated where that can be known, unless wanted(headers)."""
    src = Source(file)
    while head := src.need(24):
        if head[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member: records must be compressed one by one")
        total = None
        if head[3] == 4 and head[12:14] == b"sl":
            total = struct.unpack("<I", head[16:20])[0]
        z, text, used = zlib.decompressobj(31), b"", 0
        data = src.need(4096)
        while b"\r\n\r\n" not in text and data and not z.eof:
            text += z.decompress(data, 4096)
            used += len(data) - len(z.unused_data if z.eof else z.unconsumed_tail)
            data = z.unconsumed_tail or src.need(used + 4096)[used:]
        top, _, rest = text.partition(b"\r\n\r\n")
        lines = top.decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        keep = wanted(headers)
        if not keep and total:
            src.skip(total)
            yield headers, None
            continue
        parts = [rest]
        while not z.eof:
            data = z.unconsumed_tail or src.need(used + (1 << 16))[used:]
            if not data:
                raise ValueError("a record breaks off")
            more = z.decompress(data)
            used += len(data) - len(z.unused_data if z.eof else z.unconsumed_tail)
            if keep:
                parts.append(more)
        src.skip(used)
        yield headers, b"".join(parts)[: int(headers.get("content-length", 0))] if keep else None


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.payload = options["path"], str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        """Takes equality, membership, prefix and not-null tests of header columns; the others are Spark's."""
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else None
            if name in HEADERS and isinstance(f, (EqualTo, In, IsNotNull, StringStartsWith)):
                self.tests.append((HEADERS[name].lower(), type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        fs, root = open_fs(self.folder)
        lists = fs.get_file_info(pa.fs.FileSelector(f"{root}/_files", allow_not_found=True))
        if lists:
            names = []
            for x in lists:
                with fs.open_input_file(x.path) as f:
                    names += json.loads(f.read())
            return [File(f"{root}/{n}") for n in sorted(names)]
        found = fs.get_file_info(pa.fs.FileSelector(root, recursive=True))
        return [File(x.path) for x in found if x.path.endswith(".warc.gz")]

    def passes(self, headers: dict[str, str]) -> bool:
        for key, test, value in self.tests:
            got = headers.get(key)
            if got is None or test == "EqualTo" and got != value or test == "In" and got not in value or test == "StringStartsWith" and not got.startswith(value):
                return False
        return True

    def read(self, partition):
        if partition is None:  # an archive without files
            return
        fs, _ = open_fs(self.folder)
        schema = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in READ_SCHEMA.split(", ")])
        rows: list[tuple] = []
        held = 0
        with fs.open_input_file(partition.path) as f:
            for h, block in records(f, lambda h: self.payload and self.passes(h) and h.get("warc-type") == "response"):
                if not self.passes(h):
                    continue
                digest = h.get("warc-payload-digest", "").rpartition(":")[2]
                digest = base64.b32decode(digest).hex() if len(digest) == 32 else digest.lower() or None
                n, payload = h.get("x-payload-length"), None
                if block is not None:
                    payload = block.partition(b"\r\n\r\n")[2]
                    found = hashlib.sha1(payload).hexdigest()
                    if digest and digest != found:
                        raise ValueError(f"{h.get('warc-record-id')}: the payload does not have its digest")
                    digest, n = found, len(payload)
                rows.append((*[h.get(k.lower()) for k in HEADERS.values()], digest, None if n is None else int(n), payload))
                held += len(payload or b"")
                if len(rows) >= 1024 or held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class Written(WriterCommitMessage):
    def __init__(self, name: str | None):
        self.name = name


class WarcWriter(DataSourceArrowWriter):
    """Each task writes a file of its own name; each commit adds a list of those of the tasks that count, and readers read all lists."""

    def __init__(self, options: dict):
        self.folder, self.date = options["path"], options.get("date", "2024-01-01T00:00:00Z")

    def write(self, iterator):
        fs, root = open_fs(self.folder)
        fs.create_dir(root, recursive=True)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        for b in iterator:
            out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
            cols = [b[c].to_pylist() for c in ("page_id", "url", "html", "record_type", "refers_to", "payload_digest", "payload_bytes")]
            for row in zip(*cols):
                out.write(record(*row, self.date))
        if out:
            out.close()
        return Written(name if out else None)

    def commit(self, messages):
        fs, root = open_fs(self.folder)
        fs.create_dir(f"{root}/_files", recursive=True)
        with fs.open_output_stream(f"{root}/_files/{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([m.name for m in messages if m is not None and m.name]).encode())

    def abort(self, messages):
        fs, root = open_fs(self.folder)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return READ_SCHEMA

    def reader(self, schema):
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite):
        return WarcWriter(dict(self.options))


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, record_type and refers_to.

    Of payloads that are equal and have `least_bytes` or more, that of the largest page_id is the response, the others revisit
    it. Null html is an empty payload. A null page_id counts as the smallest; rows that tie for the largest are responses all.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha1(html)})
    last = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").drop("n")
    rows = rows.join(last, ["payload_digest", "payload_bytes"], "left")
    again = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return rows.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("last"))}).withColumn("html", F.when(again, F.lit(None)).otherwise(F.col("html"))).drop("last")


def write_warc(pages: DataFrame, folder: str, least_bytes: int = 1000) -> None:
    """Adds a record for each row of pages (page_id, url, html) to an archive; an empty table adds none.

    Payloads are compared within one call. Repeated page_ids are records of their own with one WARC-Record-ID, null ones have none
    of their pages' ids and one ID by url. Other columns, whatever their names, are not written.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    with_revisits(pages, least_bytes).write.format("warc").mode("append").option("path", folder).save()


def read_warc(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()
