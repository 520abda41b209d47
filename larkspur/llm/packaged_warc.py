"""WARC records in ZIP packages: a writer, and a reader that never unpacks them.

A package is a ZIP file with stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members of their
own, and ``indexes/index.cdx``, one line per record in order of its key with a JSON object that has the record's member, offset and
length. A reader finds the end of a package's directory from its last bytes, follows the ZIP64 locator
where there is one, parses the central directory, and learns from each member's local header where its
bytes begin. Index lines then become rows of a table, dealt by ranges of packages over tasks, and each task reads the ranges
of its records, neighbours in one read.

Pages with equal payloads of ``LEAST`` bytes or more are written once: the others are revisit records that name
the first one's. Tasks write files of unique names in the shared folder, and what counts is the
list of files that successful tasks report, so a lost or repeated task adds nothing.

Edge cases: a null payload is empty; urls are cut at nothing, but spaces and control characters in them are percent-encoded, and a
null url is ``urn:page:`` with the id; of equal payloads, rows with the smallest id are all responses, should it repeat; null ids come
after others, and are responses if all of a payload are null; other columns are ignored;
an empty table gives no packages and no rows; compressed archive members, damaged directories and payloads that
don't have their digest raise a ValueError that names the package.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.batches import bounded, text_slices
from larkspur.sources.storage import shared_dir, stored, table

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: A package is closed when it has this many bytes or records.
PACKAGE_BYTES, PACKAGE_RECORDS = 256 << 20, 200_000
#: Bytes of a package whose records are one task's, and of one read.
SPLIT_BYTES, READ_BYTES = 32 << 20, 4 << 20
#: Payloads are dealt by hash into BUCKETS; those with over a thousandth of all repeated ones (under a thousand, so) are split into SALTS.
BUCKETS, HOT, SALTS = 1 << 16, 1_000, 64

# Names and formats of packages, records and ZIP files.
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
DATE = "2000-01-01T00:00:00Z"
SAME = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = struct.Struct("<4s4H2LH")
LOCATOR = struct.Struct("<4sLQL")
END64 = struct.Struct("<4sQ2H2L4Q")
ENTRY = struct.Struct("<4s6H3L5H2L")
LOCAL = struct.Struct("<4s5H3L2H")
END_MARK, LOCATOR_MARK, END64_MARK, ENTRY_MARK, LOCAL_MARK = b"PK\5\6", b"PK\6\7", b"PK\6\6", b"PK\1\2", b"PK\3\4"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, package string, member string, record_offset long, record_length long"


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/+", "file:///", path)))


class Member(NamedTuple):
    name: str
    method: int
    packed: int
    size: int
    header: int


def _damaged(path: str, what: str) -> ValueError:
    return ValueError(f"{path}: {what}")


def directory(source: BinaryIO, size: int, path: str) -> Iterator[Member]:
    """The members that a package's central directory lists, read in blocks."""

    def at(start: int, length: int) -> bytes:
        source.seek(start)
        return source.read(length)

    tail_from = max(0, size - END.size - FULL16)
    tail = at(tail_from, size - tail_from)
    end = len(tail)
    while (end := tail.rfind(END_MARK, 0, end)) >= 0:
        if end + END.size <= len(tail) and end + END.size + END.unpack_from(tail, end)[7] == len(tail):
            break
    if end < 0:
        raise _damaged(path, "no end of a central directory")
    count, length, start = END.unpack_from(tail, end)[4:7]
    stop = tail_from + end
    locator = at(stop - LOCATOR.size, LOCATOR.size) if stop >= LOCATOR.size else b""
    if locator[:4] == LOCATOR_MARK:
        # Bytes before the package move all offsets; then the record stands just before its locator.
        for where in (LOCATOR.unpack(locator)[2], stop - LOCATOR.size - END64.size):
            found = at(where, END64.size) if 0 <= where <= size - END64.size else b""
            if found[:4] == END64_MARK:
                (count, length, start), stop = END64.unpack(found)[7:10], where
                break
    if stop == tail_from + end and (count == FULL16 or FULL32 in (length, start)):
        raise _damaged(path, "no ZIP64 end of a central directory")
    shift = stop - length - start
    if shift < 0:
        raise _damaged(path, "a central directory that doesn't fit")
    source.seek(start + shift)
    rest, used, left = b"", 0, length
    for _ in range(count):
        while len(rest) < used + ENTRY.size or len(rest) < used + ENTRY.size + sum(ENTRY.unpack_from(rest, used)[10:13]):
            more = source.read(min(left, 1 << 20))
            if not more:
                raise _damaged(path, "a central directory that ends early")
            rest, used, left = rest[used:] + more, 0, left - len(more)
        mark, _, _, flags, method, _, _, _, packed, plain, name_n, extra_n, note_n, _, _, _, header = ENTRY.unpack_from(rest, used)
        if mark != ENTRY_MARK:
            raise _damaged(path, "an entry of the central directory without its mark")
        named = used + ENTRY.size
        name, extra = rest[named : named + name_n], rest[named + name_n : named + name_n + extra_n]
        used = named + name_n + extra_n + note_n
        plain, packed, header = _wide(extra, plain, packed, header)
        yield Member(name.decode("utf-8" if flags & 0x800 else "cp437"), method, packed, plain, header + shift)


def _wide(extra: bytes, *values: int) -> list[int]:
    """Values of 32 bits, those that are full replaced by what the ZIP64 field has, in order."""
    while len(extra) >= 4:
        kind, n = struct.unpack_from("<2H", extra)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, 4))
            return [next(wide, v) if v == FULL32 else v for v in values]
        extra = extra[4 + n :]
    return list(values)


def first_byte(source: BinaryIO, member: Member, path: str) -> int:
    """Where a member's bytes begin; its local header may be longer than the directory says."""
    source.seek(member.header)
    head = source.read(LOCAL.size)
    if head[:4] != LOCAL_MARK:
        raise _damaged(path, f"no local header of {member.name}")
    return member.header + LOCAL.size + sum(LOCAL.unpack(head)[9:11])


def index_lines(source: BinaryIO, start: int, length: int) -> Iterator[bytes]:
    """The lines of a stored index, read in blocks."""
    source.seek(start)
    rest = b""
    while length:
        block = source.read(min(length, READ_BYTES))
        length = length - len(block) if block else 0
        *lines, rest = (rest + block).split(b"\n")
        yield from lines
    if rest:
        yield rest


def _url(url: str | None, page: int | None) -> str:
    return f"urn:page:{'' if page is None else page}" if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _key(url: str) -> str:
    """Host names back to front, then the path: pages of a site stand together in an index."""
    host, slash, path = url.partition("://")[2].partition("/")
    return f"{','.join(reversed(host.lower().split('.')))}){slash}{path}" if host else url


def record(page: int | None, url: str, kind: str, first: int | None, payload: bytes, digest: str) -> bytes:
    """One record; a revisit has the response's head, but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{digest}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {SAME}", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _named(line: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", line or "")
    return int(found[1]) if found else None


def parsed(raw: bytes, package: str) -> tuple[int | None, str, str, int | None, int, str, bytes | None]:
    """Page, url, type, page referred to, bytes, digest and payload (none of a revisit) of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    block = rest[: int(fields.get("content-length", -1))]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = fields.get("warc-type", ""), fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if not version.startswith("WARC/") or kind not in ("response", "revisit"):
        raise _damaged(package, "a record that is neither a response nor a revisit")
    size = int(re.search(rb"(?i)\r\ncontent-length: *([0-9]+)", http)[1])
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise _damaged(package, f"a payload of {fields.get('warc-record-id')} that doesn't have its digest")
    return _named(fields.get("warc-record-id")), fields.get("warc-target-uri", ""), kind, _named(fields.get("warc-refers-to")), size, digest, payload if kind == "response" else None


class Package:
    """A package that is being written, to a stream that can't go back."""

    def __init__(self, folder: str, most_bytes: int, most_records: int):
        self.most_bytes, self.most_records = most_bytes, most_records
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, inner = place(self.path)
        system.create_dir(inner.rpartition("/")[0], recursive=True)
        self.sink = system.open_output_stream(inner)
        self.zip = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_STORED)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.written, self.lines = 0, []

    def add(self, url: str, digest: str, raw: bytes) -> None:
        packer = zlib.compressobj(1, zlib.DEFLATED, 31)
        packed = packer.compress(raw) + packer.flush()
        about = {"url": url, "digest": f"sha256:{digest}", "filename": ARCHIVE, "offset": self.written, "length": len(packed)}
        self.lines.append(f"{_key(url)} {re.sub('[^0-9]', '', DATE)} {json.dumps(about)}\n")
        self.member.write(packed)
        self.written += len(packed)

    def full(self) -> bool:
        return self.written >= self.most_bytes or len(self.lines) >= self.most_records

    def close(self) -> tuple[str, int, int]:
        self.member.close()
        with self.zip.open(INDEX, "w") as index:
            index.write("".join(sorted(self.lines)).encode())
        self.zip.close()
        self.sink.close()
        return self.path, len(self.lines), self.written


def typed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, record_type, refers_to`` of ``pages(page_id, url, html)``.

    First ids are found by digest, combined before the shuffle. They meet the pages by digest, and by a salt where the
    digest's bucket has more than a thousandth of all repeated pages, so no payload's pages are one task's; small payloads, which meet nothing, are salted too.
    """
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    bucket = F.pmod(F.xxhash64("digest"), F.lit(BUCKETS))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).withColumn("digest", digest)
    size = F.octet_length(F.coalesce("html", F.lit("")))
    large = rows.filter(size >= LEAST)
    counted = stored(large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND first IS NOT NULL"), "firsts")
    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = [r.bucket for r in counted.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n")).filter(F.col("n") * HOT > total).collect()]  # under HOT of them
    salts = F.when(bucket.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = counted.withColumn("salt", F.explode(salts)).select("digest", "salt", "first")
    salted = rows.withColumn("salt", F.when(bucket.isin(hot) | (size < LEAST), F.pmod(F.xxhash64(F.lit("salt"), "page_id", "url"), F.lit(SALTS)).cast("int")).otherwise(0))
    again = F.col("first").isNotNull() & (F.coalesce(F.col("page_id") != F.col("first"), F.lit(True)))
    return salted.join(firsts, ["digest", "salt"], "left").select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, most_bytes: int = PACKAGE_BYTES, most_records: int = PACKAGE_RECORDS) -> DataFrame:
    """Write packages of the rows of ``typed``; ``package, records, bytes`` of those that count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for part in text_slices(batches, "html"):
            for page, url, html, digest, kind, first in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to"))):
                package = package or Package(folder, most_bytes, most_records)
                url = _url(url, page)
                package.add(url, digest, record(page, url, kind, first, (html or "").encode(), digest))
                if package.full():
                    done.append(package.close())
                    package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("package", "records", "bytes"), x)) for x in done], pa.schema([("package", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return stored(pages.mapInArrow(run, "package string, records long, bytes long"), "packages")


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """``package``: the packages of a folder that others have written; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wacz").load(folder).select(F.col("path").alias("package"))


def located(packages: DataFrame) -> DataFrame:
    """``package, member, record_offset, record_length``: where the records of ``packages(package)`` are, in bytes of the package."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("package").to_pylist():
                system, inner = place(path)
                with system.open_input_file(inner) as source:
                    members = {x.name: x for x in directory(source, source.size(), path)}
                    starts = {}
                    for name, member in members.items():
                        if re.search(r"\.(warc(\.gz)?|cdxj?)$", name):
                            if member.method:
                                raise _damaged(path, f"{name} isn't stored as it is")
                            starts[name] = first_byte(source, member, path)
                    rows = []
                    for name in starts:
                        for line in index_lines(source, starts[name], members[name].size) if re.search(r"\.cdxj?$", name) else ():
                            about = json.loads(line[line.index(b"{") :])
                            member = about["filename"] if about["filename"] in starts else f"archive/{about['filename']}"
                            rows.append((path, member, starts[member] + int(about["offset"]), int(about["length"])))
                            if len(rows) == 10_000:
                                yield _located(rows)
                                rows = []
                    yield _located(rows)

    return packages.select("package").mapInArrow(run, "package string, member string, record_offset long, record_length long")


def _located(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"package": pa.string(), "member": pa.string(), "record_offset": pa.int64(), "record_length": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _runs(offsets: np.ndarray, lengths: np.ndarray, packages: list[str], most: int) -> Iterator[tuple[int, int]]:
    """Stretches of records that are neighbours in one package, of up to ``most`` bytes (or one record)."""
    start = 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or packages[i] != packages[start] or offsets[i] != offsets[i - 1] + lengths[i - 1] or offsets[i] + lengths[i] - offsets[start] > most:
            yield start, i
            start = i


def read(records: DataFrame, split_bytes: int = SPLIT_BYTES, read_bytes: int = READ_BYTES) -> DataFrame:
    """The rows of RECORDS: the records of ``located``, read by ranges."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORDS.split(", ")]
        kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[c.split()[1]] for c in RECORDS.split(", ")]
        source, opened = None, None
        for batch in batches:
            packages, members = (batch.column(c).to_pylist() for c in ("package", "member"))
            offsets, lengths = (batch.column(c).to_numpy() for c in ("record_offset", "record_length"))
            for first, last in _runs(offsets, lengths, packages, read_bytes):
                if packages[first] != opened:
                    if source:
                        source.close()
                    opened = packages[first]
                    system, inner = place(opened)
                    source = system.open_input_file(inner)
                source.seek(int(offsets[first]))
                block, rows = memoryview(source.read(int(offsets[last - 1] + lengths[last - 1] - offsets[first]))), []
                for i in range(first, last):
                    a = int(offsets[i] - offsets[first])
                    raw = bytes(block[a : a + int(lengths[i])])
                    raw = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
                    rows.append((*parsed(raw, opened), opened, members[i], int(offsets[i]), int(lengths[i])))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)
        if source:
            source.close()

    split = F.floor(F.col("record_offset") / split_bytes)
    dealt = records.repartition(parts, "package", split).sortWithinPartitions("package", "record_offset")
    return dealt.mapInArrow(run, RECORDS)


def op12_packaged_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = bounded(table(spark, sf_dir, "pages"))
    packages = write(typed(pages), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read(located(packages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op12_packaged_warc": op12_packaged_warc}
ORACLE_SQL = {
    "op12_packaged_warc": """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM g
    """,
}
