"""WARC archives as a Spark data source, and the deduplicated writing of pages into them.

    spark.dataSource.register(WarcSource)
    spark.read.format("warc").load(folder).filter("record_type = 'response'")

Reading. The driver lists files and sizes and plans a partition for each file, or for each SPLIT_BYTES of a file that
has an index of record offsets beside it. A task unpacks the head of a record, compares it with the predicates
that Spark pushed down (type, URI, ids, digest, length), and unpacks the rest only of records that pass, and only if the
option `payload` isn't `false`. With an index the other records' bytes aren't unpacked at all.

Writing. Each task writes one archive of records packed one by one and its index, under a name of its own; the
driver's commit lists the archives that count, so what lost or repeated tasks left behind is never read.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from callytics.llm.common import short_batches, stored

SPLIT_BYTES = 64 << 20
HEAD_BYTES = 8 << 10
BATCH_BYTES = 4 << 20
LEVEL = 1
FILES = "_archives.json"

READ = (
    "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
    "payload_length long, content_type string, payload binary"
)
#: Column -> header.
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "refers_to": "warc-refers-to",
    "payload_digest": "warc-payload-digest",
    "payload_length": "x-payload-length",
    "content_type": "content-type",
}
_TESTS = {
    GreaterThan: lambda v, x: v > x,
    GreaterThanOrEqual: lambda v, x: v >= x,
    LessThan: lambda v, x: v < x,
    LessThanOrEqual: lambda v, x: v <= x,
    StringStartsWith: lambda v, x: v.startswith(x),
    EqualTo: lambda v, x: v == x,
    In: lambda v, x: v in x,
}
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
#: Where a record begins after a broken one.
NEXT_HEAD = b"\r\n\r\nWARC/"


def _open(folder: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def parse_head(head: bytes) -> dict[str, str]:
    """Fields of the head of a record, names in lower case; lines that go on are joined."""
    fields: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    return fields


def columns_of(fields: dict[str, str]) -> dict[str, str | int | None]:
    """The columns that stand in the head."""
    row: dict[str, str | int | None] = {c: fields.get(h) for c, h in HEADERS.items()}
    for c in ("record_id", "refers_to"):
        row[c] = row[c].strip("<>") if row[c] else None
    length = row["payload_length"]
    row["payload_length"] = int(length) if length and length.isdigit() else None
    return row


@dataclass(frozen=True)
class Passes:
    """A predicate that was pushed down."""

    column: str
    kind: type
    value: object

    def __call__(self, row: dict) -> bool:
        v = row[self.column]
        if self.kind is IsNull:
            return v is None
        return v is not None and (self.kind is IsNotNull or bool(_TESTS[self.kind](v, self.value)))


@dataclass
class Part(InputPartition):
    name: str
    part: int
    parts: int
    index: bool


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        if overwrite:
            raise ValueError("archives are only added to; choose a new folder")
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), schema.names)


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.folder = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))
        self.passes: list[Passes] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in HEADERS and (type(f) in _TESTS or isinstance(f, (IsNull, IsNotNull))):
                self.passes.append(Passes(column, type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow.fs import FileSelector, FileType

        files, root = _open(self.folder)
        sizes = {f.base_name: f.size for f in files.get_file_info(FileSelector(root)) if f.type == FileType.File}
        lists = [n for n in sizes if n.endswith(FILES)]
        if lists:  # archives of this writer: those that were committed
            names = []
            for n in lists:
                with files.open_input_stream(f"{root}/{n}") as f:
                    names += json.loads(f.read())
        else:
            names = [n for n in sizes if n.endswith((".warc", ".warc.gz"))]
        out: list[InputPartition] = []
        for n in sorted(names):
            index = f"{n}.idx" in sizes
            parts = max(1, math.ceil(sizes[n] / self.split)) if index else 1
            out += [Part(n, i, parts, index) for i in range(parts)]
        return out

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in for no partitions
            return
        files, root = _open(self.folder)
        rows: list[dict] = []
        size = 0
        with files.open_input_file(f"{root}/{partition.name}") as f:
            if partition.index:
                with files.open_input_stream(f"{root}/{partition.name}.idx") as i:
                    ends = np.frombuffer(i.read(), "<i8")
                share = ends[-1] / partition.parts if len(ends) else 0
                begins = ends[:-1]
                mine = np.flatnonzero((begins >= partition.part * share) & (begins < (partition.part + 1) * share))
                found = self._by_index(f, ends, mine, partition.name.endswith(".gz"))
            else:
                found = self._in_order(f, partition.name.endswith(".gz"))
            for row in found:
                rows.append(row)
                size += len(row["payload"] or b"") + 500
                if size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload_length": pa.int64(), "payload": pa.binary()}
        names = [*HEADERS, "payload"]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    def _wanted(self, row: dict) -> bool:
        return all(p(row) for p in self.passes)

    def _row(self, fields: dict[str, str], row: dict, block: bytes | None) -> dict:
        """The row of a record; the payload of an HTTP block begins after the HTTP head."""
        if block is not None and fields.get("content-type", "").startswith("application/http"):
            head, _, block = block.partition(b"\r\n\r\n")
        if block is not None and fields.get("warc-type") == "revisit":
            block = None
        return row | {"payload": block}

    def _by_index(self, f, ends: np.ndarray, mine: np.ndarray, packed: bool) -> Iterator[dict]:
        for i in mine:
            raw = f.read_at(int(ends[i + 1] - ends[i]), int(ends[i]))
            unpack = zlib.decompressobj(31) if packed else None
            data, most = (unpack.decompress(raw, HEAD_BYTES), HEAD_BYTES) if packed else (raw, 0)
            while packed and b"\r\n\r\n" not in data and unpack.unconsumed_tail:
                data += unpack.decompress(unpack.unconsumed_tail, most)
            head, _, begun = data.partition(b"\r\n\r\n")
            fields = parse_head(head)
            row = columns_of(fields)
            if not self._wanted(row):
                continue
            block = None
            if self.payload:
                rest = begun + (unpack.decompress(unpack.unconsumed_tail) + unpack.flush() if packed else b"")
                block = rest[: int(fields.get("content-length", 0))]
            yield self._row(fields, row, block)

    def _in_order(self, f, packed: bool) -> Iterator[dict]:
        """Records of an archive without index; of unwanted ones no more than a piece is in memory.

        A record whose Content-Length is missing or no whole number is left out, and reading goes on at the next head; a
        last record that is cut off is left out.
        """
        stream = _Unpacked(f) if packed else f
        data = b""
        while True:
            while b"\r\n\r\n" not in data.lstrip(b"\r\n"):
                more = stream.read(1 << 16)
                if not more:
                    return
                data += more
            head, _, data = data.lstrip(b"\r\n").partition(b"\r\n\r\n")
            fields = parse_head(head)
            row = columns_of(fields)
            length = fields.get("content-length", "")
            if not (length.isascii() and length.isdigit()):  # no way to tell where it ends: go on at the next head
                while (begin := data.find(NEXT_HEAD)) < 0:
                    more = stream.read(1 << 16)
                    if not more:
                        return
                    data = data[-len(NEXT_HEAD) :] + more
                data = data[begin:]
                continue
            left = int(length)
            keep = self._wanted(row)
            block = bytearray()
            while left:
                if not data:
                    data = stream.read(1 << 16)
                    if not data:
                        break
                piece, data = data[:left], data[left:]
                left -= len(piece)
                if keep and self.payload:
                    block += piece
            if left:  # the archive is cut off
                return
            if keep:
                yield self._row(fields, row, bytes(block) if self.payload else None)


class _Unpacked:
    """A stream over the joined members of a gzip file."""

    def __init__(self, f):
        self.f, self.raw, self.unpack = f, b"", zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        while True:
            if self.unpack.eof:
                self.raw, self.unpack = self.unpack.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.f.read(1 << 16)
                if not self.raw:
                    return b""
            out = self.unpack.decompress(self.raw, n)
            self.raw = b"" if self.unpack.eof else self.unpack.unconsumed_tail
            if out:
                return out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Rows record_id, record_type, target_uri, refers_to, payload_digest, payload_length, payload; others are left out."""

    def __init__(self, folder: str, date: str, names: list[str]):
        self.folder, self.date, self.names = folder, date, names

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, root = _open(self.folder)
        files.create_dir(root)
        name, out, ends = f"part-{uuid4().hex}.warc.gz", None, [0]
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)  # packed here, record by record
                pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                record = pack.compress(self.record(row)) + pack.flush()
                out.write(record)
                ends.append(ends[-1] + len(record))
        if out is None:
            return Written([])
        out.close()
        with files.open_output_stream(f"{root}/{name}.idx") as f:
            f.write(np.array(ends, "<i8").tobytes())
        return Written([name])

    def record(self, row: dict) -> bytes:
        """A record; text that could break its head is percent-encoded."""
        safe = lambda v: _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", str(v))
        payload = row["payload"] or b""
        http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        length = row.get("payload_length")
        http += f"Content-Length: {len(payload) if length is None else length}\r\n\r\n"
        block = http.encode() + payload
        head = ["WARC/1.1", f"WARC-Type: {safe(row['record_type'])}", f"WARC-Record-ID: <{safe(row['record_id'])}>"]
        head += [f"WARC-Date: {self.date}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
        if row.get("target_uri") is not None:
            head.append(f"WARC-Target-URI: {safe(row['target_uri'])}")
        if row.get("payload_digest") is not None:
            head.append(f"WARC-Payload-Digest: {safe(row['payload_digest'])}")
        if length is not None:
            head.append(f"X-Payload-Length: {length}")
        if row.get("refers_to") is not None:
            head.append(f"WARC-Refers-To: <{safe(row['refers_to'])}>")
            head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _open(self.folder)
        files.create_dir(root)
        names = [n for m in messages if m for n in m.names]
        with files.open_output_stream(f"{root}/{uuid4().hex}{FILES}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _open(self.folder)
        for n in (n for m in messages if m for n in m.names):
            for path in (f"{root}/{n}", f"{root}/{n}.idx"):
                files.delete_file(path)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records_of(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Records of pages: the payload is the html in UTF-8, empty for null.

    Of equal payloads of at least `least` bytes, the pages with the smallest id are responses and all others revisit it.
    Rows that repeat this id with this payload are all responses. A null id is never the smallest, and payloads
    that only rows without id have are all responses. A record's id is urn:page:<page_id>.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("target_uri"),
        F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "payload_length": F.octet_length("payload").cast("long")})
    # Payloads that stand more than once: counted before the shuffle, so a group of copies is a few rows.
    first = stored(
        rows.filter(F.col("payload_length") >= least)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .filter("n > 1 and first_id is not null")
        .select("digest", "first_id"),
        "payloads",
    )
    revisits = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return rows.join(first, "digest", "left").select(
        urn("page_id").alias("record_id"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        F.when(revisits, urn("first_id")).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        "payload_length",
        F.when(~revisits, F.col("payload")).alias("payload"),
    )


def write_pages(pages: DataFrame, folder: str, **names) -> None:
    """Write a table of pages as archives into a new folder; an empty table gives a folder without archives."""
    register(pages.sparkSession)
    short_batches(pages.sparkSession)
    records_of(pages, **names).write.format("warc").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(folder)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read with their payloads.

    Length and digest of responses are those of the payload that was read; a revisit has them in its head.
    """
    page = lambda c: F.expr(f"try_cast(nullif(substring({c}, 10), 'none') as bigint)")
    response = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring("payload_digest", 8, 64)).alias("payload_digest"),
        "record_type",
        page("refers_to").alias("refers_to"),
    )
