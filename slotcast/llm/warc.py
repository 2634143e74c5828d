"""WARC archives as a PySpark data source, and archives of pages without repeated payloads."""

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from slotcast.sources.storage import new_path

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, refers_to string, payload_length long, payload binary, "
    "file string, offset long"
)
#: Columns that stand in the header line of that name (fixed values of the format).
HEADERS = {
    "record_id": "warc-record-id",
    "record_type": "warc-type",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PREFIX = ("_", ".")
#: Files are read in steps of this many bytes.
_STEP = 1 << 18


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``.

    A schema of some of the columns may be given for reading; without ``payload`` no
    payload is decoded. Options: ``partition_bytes`` (how much a task reads, 64 MB) and ``verify``
    (check the digests of the payloads that are read).
    """

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> "WarcReader":
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> "WarcWriter":
        return WarcWriter(self.options["path"], overwrite)


@dataclass
class Files(InputPartition):
    """Archives that one task reads."""

    paths: tuple[str, ...]


class WarcReader(DataSourceReader):
    """Reads records header first and passes over those the pushed filters reject."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path = options["path"]
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.verify = options.get("verify", "false").lower() == "true"
        self.names = schema.fieldNames()
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality, membership and prefixes of columns that stand in the header."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | EqualNullSafe) and f.value is not None:
                self.tests.append((column, "in", (f.value,)))
            elif column in HEADERS and isinstance(f, In):
                self.tests.append((column, "in", tuple(f.value)))
            elif column in HEADERS and isinstance(f, StringStartsWith):
                self.tests.append((column, "prefix", (f.value,)))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        system, root = _open(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        found += [i for i in [system.get_file_info(root)] if i.is_file]
        files = sorted(
            (i.size, i.path)
            for i in found
            if i.is_file
            and not any(p.startswith(_PREFIX) for p in posixpath.relpath(i.path, root).split("/")[:-1])
            and not i.base_name.startswith(_PREFIX)
        )
        lots: list[list[str]] = []
        room = 0
        for size, path in files:
            if not lots or size > room:
                lots.append([])
                room = self.most
            lots[-1].append(path)
            room -= size
        return [Files(tuple(lot)) for lot in lots or [[]]]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _open(self.path)
        rows: list[dict] = []
        size = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for row in self._records(file, path):
                    rows.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield self._batch(rows)
                        rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {"payload": pa.binary(), "payload_length": pa.int64(), "offset": pa.int64()}
        arrays = [pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in self.names]
        return pa.RecordBatch.from_arrays(arrays, names=self.names)

    def _records(self, file: pa.NativeFile, path: str) -> Iterator[dict]:
        end, at = file.size(), 0
        while at < end:
            member = _Member(file, at)
            headers = member.headers()
            at_record, at = at, None
            if self._wanted(headers):
                yield self._row(member, headers, path, at_record)
            at = member.end()

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, values in self.tests:
            own = headers.get(HEADERS[column])
            if own is None or not (own in values if kind == "in" else own.startswith(values)):
                return False
        return True

    def _row(self, member: "_Member", headers: dict[str, str], path: str, offset: int) -> dict:
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        row |= {"file": path, "offset": offset, "payload": None, "payload_length": None}
        http = member.block_headers(int(headers.get("content-length", 0)))
        if http is not None and "content-length" in http:
            row["payload_length"] = int(http["content-length"])
        if "payload" in self.names and headers.get("warc-type") != "revisit":
            row["payload"] = member.payload()
            if self.verify and row["payload_digest"] != digest(row["payload"]):
                raise ValueError(f"{path} at {offset}: the payload differs from its digest")
        return row


class _Member:
    """One record, a gzip member, decompressed only as far as asked for."""

    def __init__(self, file: pa.NativeFile, at: int):
        self.file, self.at = file, at
        self.inflate = zlib.decompressobj(31)
        self.read_to, self.text, self.left = at, b"", b""
        self.length = self._stated_length()

    def _stated_length(self) -> int | None:
        """The compressed length, if the gzip header's extra field ``sl`` tells it."""
        self.file.seek(self.at)
        head = self.file.read(24)
        if len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            return int.from_bytes(head[16:20], "little")
        return None

    def _more(self, most: int = 1 << 13) -> bool:
        """Decompress a little more; false at the end of the record."""
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail
        if not raw:
            self.file.seek(self.read_to)
            room = _STEP if self.length is None else self.at + self.length - self.read_to
            raw = self.file.read(min(room, _STEP))
            self.read_to += len(raw)
            if not raw:
                raise ValueError(f"the record at {self.at} is cut off")
        self.text += self.inflate.decompress(raw, most)
        return True

    def _until(self, mark: bytes, start: int) -> int:
        while (found := self.text.find(mark, start)) < 0:
            if not self._more():
                return -1
        return found

    @staticmethod
    def _lines(block: bytes) -> dict[str, str]:
        pairs = (line.partition(":") for line in block.decode("utf-8", "replace").split("\r\n")[1:])
        return {name.strip().lower(): value.strip() for name, _, value in pairs}

    def headers(self) -> dict[str, str]:
        stop = self._until(b"\r\n\r\n", 0)
        if stop < 0:
            raise ValueError(f"no record header at {self.at}")
        self.body = stop + 4
        return self._lines(self.text[:stop])

    def block_headers(self, length: int) -> dict[str, str] | None:
        """The HTTP headers that the block begins with."""
        self.stop = self.body + length
        while len(self.text) < min(self.body + 5, self.stop) and self._more():
            pass
        if not self.text[self.body :].startswith(b"HTTP/"):
            self.payload_at = self.body
            return None
        found = self._until(b"\r\n\r\n", self.body)
        self.payload_at = min(found + 4 if found >= 0 else self.stop, self.stop)
        return self._lines(self.text[self.body : self.payload_at - 4])

    def payload(self) -> bytes:
        parts = [self.text]
        have = len(self.text)
        while have < self.stop:
            self.text = b""
            if not self._more(1 << 20):
                raise ValueError(f"the record at {self.at} is cut off")
            parts.append(self.text)
            have += len(self.text)
        self.text = b"".join(parts)
        return self.text[self.payload_at : self.stop]

    def end(self) -> int:
        """Where the next record begins; without a stated length the rest is decompressed."""
        if self.length is not None:
            return self.at + self.length
        while not self.inflate.eof:
            self.text = b""
            self._more(1 << 20)
        return self.read_to - len(self.inflate.unused_data)


def digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int = 5) -> bytes:
    """A record as a gzip member whose header tells its compressed and its full length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    tail = zlib.crc32(record).to_bytes(4, "little") + (len(record) % (1 << 32)).to_bytes(4, "little")
    lengths = [24 + len(body) + 8, len(record)]
    extra = b"sl" + (8).to_bytes(2, "little")
    extra += b"".join((x % (1 << 32)).to_bytes(4, "little") for x in lengths)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + len(extra).to_bytes(2, "little")
    return head + extra + body + tail


def record(row: dict) -> bytes:
    """A response or revisit record. A revisit keeps the HTTP headers, without the payload."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"] or b""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {row['payload_length']}\r\n\r\n"
    ).encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: {row['record_id']}",
        f"WARC-Date: {row['date']}",
        f"WARC-Payload-Digest: {row['payload_digest']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + len(payload)}",
    ]
    if row["target_uri"] is not None:
        uri = row["target_uri"].replace("\r", "%0D").replace("\n", "%0A")
        lines.append(f"WARC-Target-URI: {uri}")
    if revisit:
        lines += [f"WARC-Refers-To: {row['refers_to']}", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class WarcWriter(DataSourceArrowWriter):
    """Writes one archive per task; an archive shows once all tasks have succeeded."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = _open(self.path)
        place = f"{root}/_temporary-{self.run}"
        system.create_dir(place, recursive=True)
        out, path = None, f"{place}/{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    out = out or system.open_output_stream(path, compression=None)
                    out.write(member(record(row)))
        finally:
            if out is not None:
                out.close()
        return _Written(path if out is not None else None)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        place = f"{root}/_temporary-{self.run}"
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
                if old.is_file and old.base_name.endswith(".warc.gz"):
                    system.delete_file(old.path)
        system.create_dir(root, recursive=True)
        for i, message in enumerate(messages):
            if message is not None and message.path is not None:
                system.move(message.path, f"{root}/part-{i:05d}-{self.run}.warc.gz")
        self._drop(system, place)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _open(self.path)
        self._drop(system, f"{root}/_temporary-{self.run}")

    @staticmethod
    def _drop(system: fs.FileSystem, place: str) -> None:
        if system.get_file_info(place).type == fs.FileType.Directory:
            system.delete_dir(place)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters pushed to Python sources."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def page_records(
    pages: DataFrame,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    least_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """A record for every page, in the columns the ``warc`` format writes.

    Of pages with equal payloads of at least ``least_bytes`` bytes the one with the smallest
    key is a response and the others revisit it. Null html counts as empty. Rows that
    repeat the smallest key are responses too; a null key revisits, unless all keys of
    its payload are null.

    Payloads are compared by SHA-1. Groups meet as digests and keys only, so a payload that
    many pages share isn't gathered anywhere, and only responses carry theirs.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    plain = pages.select(
        F.col(key).alias("k"), F.col(url).alias("u"), F.sha1(payload).alias("d"), payload.alias("p")
    )
    rows = plain.select("k", "u", "d", F.octet_length("p").cast("long").alias("n"))
    first = rows.filter(F.col("n") >= least_bytes).groupBy("d").agg(F.min("k").alias("first"))
    judged = rows.join(first, "d", "left").withColumn(
        "again", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("k"))
    )
    kept = judged.filter(~F.col("again")).select("k", "d").distinct()
    a, b = plain.alias("a"), kept.alias("b")
    same = F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.d") == F.col("b.d"))
    responses = a.join(b, same, "left_semi").select(
        "k", "u", "d", F.octet_length("p").cast("long").alias("n"), "p", F.lit(None).alias("first")
    )
    revisits = judged.filter("again").select(
        "k", "u", "d", "n", F.lit(None).cast("binary").alias("p"), "first"
    )
    both = responses.unionByName(revisits)
    return both.select(
        _record_id(F.col("k")).alias("record_id"),
        F.when(F.col("first").isNull(), "response").otherwise("revisit").alias("record_type"),
        F.col("u").alias("target_uri"),
        F.lit(date).alias("date"),
        _digest_text(F.col("d")).alias("payload_digest"),
        F.when(F.col("first").isNotNull(), _record_id(F.col("first"))).alias("refers_to"),
        F.col("n").alias("payload_length"),
        F.col("p").alias("payload"),
    )


def _record_id(key: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))


def _digest_text(hexadecimal: Column) -> Column:
    """``sha1:`` and the base32 of a digest: every five hex signs are four of base32."""
    signs = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

    def four(i: int) -> list[Column]:
        number = F.conv(F.substring(hexadecimal, i, 5), 16, 10).cast("int")
        return [
            F.substring(F.lit(signs), F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1))
            for s in (15, 10, 5, 0)
        ]

    return F.concat(F.lit("sha1:"), *[sign for i in range(1, 41, 5) for sign in four(i)])


def page_of(record_id: Column) -> Column:
    """The page id of a record id; null if it has none."""
    return F.nullif(F.regexp_extract(record_id, "^<urn:x-page:(.*)>$", 1), F.lit("")).cast("long")


def archive_pages(pages: DataFrame, folder: str | None = None, **columns) -> DataFrame:
    """Write a record for every page and read the archives back.

    Returns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to``.
    Responses are read with their payloads, whose digests are checked; revisits without.
    """
    spark = pages.sparkSession
    register(spark)
    folder = folder or new_path(spark, "warc")
    page_records(pages, **columns).write.format("warc").mode("append").save(folder)
    base = "record_id string, record_type string, payload_digest string, refers_to string, "
    full = spark.read.format("warc").option("verify", "true")
    responses = full.schema(base + "payload binary").load(folder)
    responses = responses.filter(F.col("record_type") == "response").withColumn(
        "payload_length", F.octet_length("payload").cast("long")
    )
    revisits = spark.read.format("warc").schema(base + "payload_length long").load(folder)
    revisits = revisits.filter(F.col("record_type") == "revisit")
    both = responses.drop("payload").unionByName(revisits)
    return both.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to")).alias("refers_to"),
    )
