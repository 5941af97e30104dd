"""WARC archives as a PySpark Python data source.

Writing: each task writes one archive in which every record is a gzip member of its own whose extra
field ``sl`` holds the member's compressed and plain lengths. On commit the names of the archives
are listed in a manifest, so files of lost or repeated attempts are never read.

Reading: archives are planned into file partitions; in a folder without a manifest all ``.warc.gz`` and ``.warc`` files
are. Filters on ``warc_type`` and on the headers that are columns (``record_id``, ``refers_to``, ``digest``) are taken
over by the reader. Of a record the reader first inflates the headers only; if they fail a filter, or if no column of
the schema needs the payload, the rest of the member is passed over by its length (members of other writers that do
not tell it are inflated without being kept). Of HTTP messages the body is the payload. What is cut off, or is no
record, raises ValueError with the file's name and the place.

Nulls: a null html is an empty payload. Records with payloads of at least ``least`` bytes that are equal (by
SHA-1 and length) form a group: the one with the largest id is its response, the others are revisits
without a body. A null id sorts first and never is the referred one unless all ids are null; url may be null.
Repeated rows are written once each, with record ids of their own; an empty table gives no archive; other columns of
pages are left out. A very long page is held whole by one task.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import file_folder, store

SCHEMA = "page_id long, warc_type string, record_id string, refers_to long, refers_uri string, target_uri string, digest string, payload_bytes long, payload binary"
#: What a revisit is (a fixed value).
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_FILTERED = ("warc_type", "record_id", "refers_to", "digest")
#: Bytes of rows that one Arrow batch of the reader holds, about.
BATCH_BYTES = 4 << 20


def record(page_id: int | None, kind: str, uri: str | None, digest: str, size: int, refers_to: int | None, payload: bytes, refers_uri: str | None = None, date: str = "1970-01-01T00:00:00Z", name: str | None = None) -> bytes:
    """One record as a gzip member that knows its length. date: of its capture; name: its record id, a new one if not given."""
    plain_uri = lambda x: x.replace("\r", "%0D").replace("\n", "%0A")
    headers = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name or f'<urn:uuid:{uuid.uuid4()}>'}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        headers.append(f"X-Page-ID: {page_id}")
    if uri is not None:
        headers.append("WARC-Target-URI: " + plain_uri(uri))
    if kind == "revisit":
        headers.append(f"WARC-Profile: {PROFILE}")
        headers += [f"WARC-Refers-To-Target-URI: {plain_uri(refers_uri)}"] * (refers_uri is not None) + [f"X-Refers-To-Page: {refers_to}"] * (refers_to is not None)
    head = "\r\n".join([*headers, f"Content-Length: {len(payload)}", "", ""]).encode()
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    # headers end in a block of their own, so they can be inflated alone
    body = packer.compress(head) + packer.flush(zlib.Z_FULL_FLUSH) + packer.compress(payload + b"\r\n\r\n") + packer.flush()
    plain = head + payload + b"\r\n\r\n"
    size_ = 10 + 2 + 12 + len(body) + 8
    extra = struct.pack("<HBBHII", 12, ord("s"), ord("l"), 8, size_, len(plain) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


@dataclass
class _Written(WriterCommitMessage):
    name: str
    size: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        name, out = f"{uuid.uuid4().hex}.warc.gz", None
        for batch in iterator:
            for row in batch.to_pylist():
                out = out or fs.open_output_stream(f"{folder}/{name}", compression=None)
                payload = b"" if row["warc_type"] == "revisit" else row["payload"] or b""
                out.write(record(row["page_id"], row["warc_type"], row["target_uri"], row["digest"], row["payload_bytes"], row["refers_to"], payload, row["refers_uri"], self.date))
        if out is None:
            return _Written("", 0)
        size = out.tell()
        out.close()
        return _Written(name, size)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = store(self.path)
        fs.create_dir(folder, recursive=True)
        with fs.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps([[m.name, m.size] for m in messages if m is not None and m.name]).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, folder = store(self.path)
        for m in messages:
            if m is not None and m.name:
                fs.delete_file(f"{folder}/{m.name}")


class _Archive(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.schema, self.tests = path, schema, []

    def pushFilters(self, filters: list) -> Iterator:
        self.tests = []
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in _FILTERED and isinstance(f, (EqualTo, In, IsNull, IsNotNull)):
                self.tests.append((column, "null" if isinstance(f, IsNull) else "some" if isinstance(f, IsNotNull) else [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, folder = store(self.path)
        if fs.get_file_info(f"{folder}/manifest.json").type == pafs.FileType.NotFound:
            # archives of others: all that are there
            found = sorted(x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.base_name.endswith((".warc.gz", ".warc")))
        else:
            with fs.open_input_stream(f"{folder}/manifest.json") as file:
                found = [name for name, _ in json.loads(file.read())]
        return [_Archive(name) for name in found] or [_Archive("")]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        kinds = {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        names = [f.name for f in self.schema.fields]
        schema = pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in self.schema.fields])
        rows, held = [], 0
        for row in self._records(partition.name, "payload" in names) if partition.name else ():
            rows.append(row)
            held += 200 + len(row.get("payload") or b"")
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in names}, schema=schema)

    def _records(self, name: str, payloads: bool) -> Iterator[dict]:
        fs, folder = store(self.path)
        with fs.open_input_file(f"{folder}/{name}") as file:
            window = _Window(file, name)
            at = 0
            while at < window.end:
                member = (_Plain if name.endswith(".warc") else _Member)(window, at)
                text = member.read(4096)
                while b"\r\n\r\n" not in text:
                    more = member.read(4096)
                    if not more:
                        raise ValueError(f"{name}: the record at byte {at} ends within its headers")
                    text += more
                head, rest = text.split(b"\r\n\r\n", 1)
                row = self._headers(head, name, at)
                length = row.pop("length")
                if all(_passes(row[c], wanted) for c, wanted in self.tests):
                    if payloads:
                        parts, held = [rest], len(rest)
                        while held < length and (more := member.read(1 << 20)):
                            parts.append(more)
                            held += len(more)
                        if held < length:
                            raise ValueError(f"{name}: the record at byte {at} has {held} of {length} bytes")
                        block = b"".join(parts)[:length]
                        row["payload"] = _body(block) if row.pop("http") else block
                    yield row
                at = member.past(len(head) + 4 + length)

    @staticmethod
    def _headers(head: bytes, name: str, at: int) -> dict:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"{name}: no record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        number = lambda k: int(fields[k]) if k in fields else None
        digest, refers = fields.get("warc-payload-digest"), number("x-refers-to-page")
        try:
            length = int(fields["content-length"])
        except (KeyError, ValueError):
            raise ValueError(f"{name}: the record at byte {at} does not say its length") from None
        return {
            "page_id": number("x-page-id"), "warc_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "refers_to": refers, "refers_uri": fields.get("warc-refers-to-target-uri"),
            "target_uri": fields.get("warc-target-uri"), "digest": digest.partition(":")[2] if digest else None, "payload_bytes": number("x-payload-length") if "x-payload-length" in fields else length, "length": length,
            "http": fields.get("content-type", "").startswith("application/http"),
        }


class _Window:
    """A file read about a megabyte at a time."""

    def __init__(self, file: pa.NativeFile, name: str):
        self.file, self.name, self.end, self.base, self.data = file, name, file.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = min(n, self.end - at)
        if n > 0 and not self.base <= at <= at + n <= self.base + len(self.data):
            self.base, self.data = at, self.file.read_at(min(max(n, 1 << 20), self.end - at), at)
        return self.data[at - self.base : at - self.base + n] if n > 0 else b""


class _Plain:
    """A record of an archive that is not compressed."""

    def __init__(self, window: _Window, at: int):
        self.window, self.first, self.at = window, at, at

    def read(self, n: int) -> bytes:
        out = self.window.get(self.at, n)
        self.at += len(out)
        return out

    def past(self, size: int) -> int:
        if self.first + size > self.window.end:
            raise ValueError(f"{self.window.name}: the record at byte {self.first} is cut off")
        return self.first + size + 4


class _Member:
    """A gzip member, inflated as far as it is asked for. One whose extra field tells its length is passed over without inflating the rest."""

    def __init__(self, window: _Window, at: int):
        self.window, self.first = window, at
        head = window.get(at, 10)
        if len(head) < 10 or head[:3] != b"\x1f\x8b\x08":
            raise ValueError(f"{window.name}: no gzip member at byte {at}")
        self.length, place, flags = None, at + 10, head[3]
        if flags & 4:
            size = int.from_bytes(window.get(place, 2), "little")
            extra, place = window.get(place + 2, size), place + 2 + size
            while len(extra) >= 4:
                n = int.from_bytes(extra[2:4], "little")
                if extra[:2] == b"sl" and n == 8 and len(extra) >= 12:
                    self.length = int.from_bytes(extra[4:8], "little")
                extra = extra[4 + n :]
        for bit in (8, 16):  # a name, a comment
            while flags & bit and window.get(place, 1) not in (b"\0", b""):
                place += 1
            place += bool(flags & bit)
        self.at, self.inflate = place + 2 * bool(flags & 2), zlib.decompressobj(-15)

    def read(self, n: int) -> bytes:
        """n bytes, fewer where the member ends."""
        out = b""
        while len(out) < n and not self.inflate.eof:
            data = self.inflate.unconsumed_tail or self._more()
            out += self.inflate.decompress(data, n - len(out))
        return out

    def _more(self) -> bytes:
        data = self.window.get(self.at, 8192)
        if not data:
            raise ValueError(f"{self.window.name}: the member at byte {self.first} is cut off")
        self.at += len(data)
        return data

    def past(self, size: int) -> int:
        """Where the next member begins."""
        if self.length:
            if self.first + self.length > self.window.end:
                raise ValueError(f"{self.window.name}: the member at byte {self.first} is cut off")
            return self.first + self.length
        while not self.inflate.eof:
            self.read(1 << 20)
        return self.at - len(self.inflate.unused_data) + 8


def _body(block: bytes) -> bytes:
    """What follows the headers of an HTTP message."""
    return block.partition(b"\r\n\r\n")[2]


def _passes(value, wanted) -> bool:
    return value is None if wanted == "null" else value is not None if wanted == "some" else value in wanted


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], self.options.get("date") or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records(pages: DataFrame, least: int = 1000) -> DataFrame:
    """The records to write: payload, digest, type and the page referred to."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    # one row for each payload that more than one page has
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("last"), F.max_by("target_uri", "page_id").alias("last_uri"), F.count("*").alias("n")).filter("n > 1").drop("n")
    rows = rows.join(shared, ["digest", "payload_bytes"], "left")
    revisit = F.coalesce(F.col("last") != F.col("page_id"), F.col("last").isNotNull())
    return rows.select("page_id", F.when(revisit, "revisit").otherwise("response").alias("warc_type"), F.lit("").alias("record_id"), F.when(revisit, F.col("last")).alias("refers_to"), F.when(revisit, F.col("last_uri")).alias("refers_uri"), "target_uri", "digest", "payload_bytes", "payload")


def archived(pages: DataFrame, path: str | None = None, least: int = 1000) -> str:
    """Writes the pages as archives; the folder they are in."""
    spark = pages.sparkSession
    register(spark)
    path = path or file_folder(spark, "warc")
    records(pages, least).write.format("warc").mode("append").option("path", path).save()
    return path


def opened(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of a folder of archives; without payload only headers are inflated. Filters go to the reader of this one frame."""
    register(spark)
    return spark.read.format("warc").schema(SCHEMA if payload else SCHEMA.rpartition(",")[0]).option("path", path).load()


def digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to, those of responses from the payload as read."""
    said = opened(spark, path, False).filter(F.col("warc_type") == "revisit").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "warc_type", "refers_to")
    full = opened(spark, path).filter(F.col("warc_type") == "response").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "warc_type", "refers_to")
    return full.union(said).withColumnRenamed("warc_type", "record_type").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
