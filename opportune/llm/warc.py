"""WARC archives: written in parallel with an index, read back by byte ranges.

Each task writes archives of records that are gzip members of their own, under names that no other attempt has, and returns an
index row for each record: file, offset, length, URL and digest. The index is what counts: files of lost or repeated attempts
are in no row of it. A payload that occurs more than once is written once; later copies are revisit records, which hold its
digest and name the record that has it.

Reading starts from index rows. They are dealt out by file and stretch of the file, sorted by offset, and ranges that touch or
nearly do are read at once, in runs of bounded size.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import checkpoint_root, file_system
from .common import possibly_in, prepare, unused, with_key_rows, written

#: Payloads of fewer bytes are always written themselves.
LEAST_REVISIT = 100
#: Bytes of archive after which a task begins another one.
ARCHIVE = 1 << 30
#: Ranges no further apart than GAP are read at once, as long as the run has at most RUN bytes; a longer record is a run of its own.
GAP, RUN = 1 << 16, 8 << 20
#: Bytes of a file whose records one task reads, about.
STRETCH = 64 << 20
LEVEL = 1
DATE = "1970-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "row_id string, file string, offset bigint, length bigint, url string, digest string, payload_bytes bigint, record_type string, refers_to string"
RECORD = "row_id string, url string, record_type string, refers_to string, payload binary, payload_bytes bigint, payload_digest string"


def record(record_type: str, url: str | None, row_id: str | None, digest: str, size: int, payload: bytes | None, refers_to: str | None, date: str, record_id: str) -> bytes:
    """A response or revisit record; without payload the HTTP header alone is its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:uuid:{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))  # no line may end within a header
    lines.append(f"WARC-Payload-Digest: sha256:{digest}")
    if record_type == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
        lines += [f"WARC-Refers-To-Row: {refers_to}"] if refers_to is not None else []
    lines += [f"WARC-Row: {row_id}"] if row_id is not None else []
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Header fields of a record and of its HTTP block, in lower case, and the payload; ValueError if it isn't whole."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    size = int(fields["content-length"])
    if not first.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole record")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, {k.lower(): v for k, v in (line.split(": ", 1) for line in http.decode().split("\r\n")[1:])}, payload


def _writer(folder: str, date: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            rows = []
            for row_id, url, kind, refers_to, digest, size, payload in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and out.tell() >= most:
                    out.close()
                    out = None
                if out is None:
                    store, root = fs.FileSystem.from_uri(folder)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, offset = store.open_output_stream(f"{root}/{name}", compression=None), 0
                    info = b"software: opportune\r\nformat: WARC File Format 1.1\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    member = gzip.compress(head.encode() + info + b"\r\n\r\n", LEVEL, mtime=0)
                    out.write(member)
                    offset += len(member)
                data = record(kind, url, row_id, digest, size, payload if kind == "response" else None, refers_to, date, str(uuid.uuid4()))
                member = gzip.compress(data, LEVEL, mtime=0)
                out.write(member)
                rows.append((row_id, name, offset, len(member), url, digest, size, kind, refers_to))
                offset += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INDEX.types)], schema=_INDEX)
        if out is not None:
            out.close()

    return write


_INDEX = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in (c.split() for c in INDEX.split(", "))])


def typed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(row_id, url, record_type, refers_to, digest, size, payload) of each row: what its record holds.

    Of rows with equal payloads of `least` bytes or more that with the smallest id (nulls last, then the smallest URL) is the
    response, the others are revisits and carry no payload. Only ids and digests are grouped; payloads that occur once stay in
    place, and those of hot groups as well.
    """
    payload = F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload").cast("bigint")})
    own = F.struct(F.col("id").isNull().alias("no_id"), "id", F.col("url").isNull().alias("no_url"), "url")
    keys = rows.where(F.col("size") >= least).groupBy("digest", own.alias("own")).agg(F.count("*").alias("equal"))
    firsts = keys.groupBy("digest").agg(F.min(F.struct("own", "equal")).alias("first"), F.sum("equal").alias("copies")).where("copies > 1")
    firsts = written(firsts.select("digest", F.xxhash64("digest").alias("key"), F.col("first.own").alias("first"), F.col("first.equal").alias("equal"), "copies"), "copies")
    final = lambda df, kind, refers_to, p: df.select(F.col("id").cast("string").alias("row_id"), "url", F.lit(kind).alias("record_type"), refers_to.cast("string").alias("refers_to"), "digest", "size", p.cast("binary").alias("payload"))
    none = F.lit(None)
    if firsts.isEmpty():
        return final(rows, "response", none, F.col("payload"))
    alone, maybe = possibly_in(rows, F.xxhash64("digest"), firsts, "key")
    short = maybe.where(F.col("size") < least)
    maybe = maybe.where(F.col("size") >= least)
    known = with_key_rows(maybe, firsts.drop("key"), "digest", "copies", "left")
    copied = known.where("copies is not null")
    single = known.where("copies is null").select(rows.columns)  # of another payload that shares its mark in the bitmap
    is_first = own.eqNullSafe(F.col("first"))
    out = final(alone.unionByName(short).unionByName(single), "response", none, F.col("payload"))
    out = out.unionByName(final(copied.where(~is_first), "revisit", F.col("first.id"), none))
    out = out.unionByName(final(copied.where(is_first & (F.col("equal") == 1)), "response", none, F.col("payload")))
    # rows equal in id, URL and payload can't be told apart: one of them is the response, and so many revisits are added as the others are
    again = copied.where(is_first & (F.col("equal") > 1))
    out = out.unionByName(final(again.dropDuplicates(["digest"]), "response", none, F.col("payload")))
    parts = firsts.where("equal > 1").withColumn("part", F.explode(F.expr("sequence(1, equal - 1, 100000)"))).repartition("digest", "part")
    more = parts.withColumn("each", F.explode(F.expr("sequence(part, least(part + 99999, equal - 1))"))).join(again.select("digest", "size").distinct(), "digest")
    return out.unionByName(final(more.select("digest", "size", "first.id", "first.url", "first"), "revisit", F.col("first.id"), none))


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared one, removed when the driver ends."""
    folder = f"{checkpoint_root(spark)}/opportune/warc-{uuid.uuid4().hex}"
    hadoop, path = file_system(spark, folder)
    hadoop.mkdirs(path)
    hadoop.deleteOnExit(path)
    return folder


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST_REVISIT, date: str = DATE, most: int = ARCHIVE) -> DataFrame:
    """Write a record for each row of pages to archives in `folder`; returns the index, a written table (see INDEX).

    folder: a URI that executors share and PyArrow can open, which exists. Ids are kept as text. Null payloads are empty, null URLs
    leave the record's URL out; control characters and blanks in URLs are percent-encoded in records, not in the index. Repeated
    rows get a record each. An empty table gives no archive and an empty index. Other columns are ignored.
    """
    prepare(pages.sparkSession)
    rows = typed(pages, id_col, url_col, payload_col, least)
    return written(rows.mapInArrow(_writer(folder, date, most), INDEX), "index")


def runs(ranges: Iterable[tuple[int, int]], gap: int = GAP, most: int = RUN) -> list[tuple[int, int, int, int]]:
    """Coalesces sorted (offset, length): (first, past last, start, end) of those that are read at once."""
    out: list[tuple[int, int, int, int]] = []
    for k, (offset, length) in enumerate(ranges):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            first, _, start, end = out[-1]
            out[-1] = (first, k + 1, start, max(end, offset + length))
        else:
            out.append((k, k + 1, offset, offset + length))
    return out


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        opened, name = None, None
        for batch in batches:
            wanted = list(zip(*(c.to_pylist() for c in batch.columns)))
            start = 0
            while start < len(wanted):
                if wanted[start][0] != name:
                    if opened is not None:
                        opened.close()
                    name = wanted[start][0]
                    opened = store.open_input_file(f"{root}/{name}")
                stop = start
                while stop < len(wanted) and wanted[stop][0] == name:
                    stop += 1
                part = wanted[start:stop]
                for first, last, low, high in runs([w[1:3] for w in part]):
                    data = memoryview(opened.read_at(high - low, low))
                    rows = []
                    for _, offset, length, row_id, url, kind, refers_to, digest in part[first:last]:
                        fields, http, payload = parsed(zlib.decompress(data[offset - low : offset - low + length], 31))
                        if fields["warc-payload-digest"] != f"sha256:{digest}" or fields["warc-type"] != kind or fields.get("warc-row") != row_id or fields.get("warc-refers-to-row") != refers_to:
                            raise ValueError(f"{name} at {offset}: not the record that the index names")
                        # a revisit's length and digest are those of the payload that it refers to
                        got, size = (hashlib.sha256(payload).hexdigest(), len(payload)) if kind == "response" else (digest, int(http["content-length"]))
                        if got != digest:
                            raise ValueError(f"{name} at {offset}: the payload isn't that of its digest")
                        rows.append((fields.get("warc-row"), url, fields["warc-type"], fields.get("warc-refers-to-row"), payload if with_payload and kind == "response" else None, size, got))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RECORD.types)], schema=_RECORD)
                start = stop
        if opened is not None:
            opened.close()

    return read


_RECORD = pa.schema([(n, {"bigint": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (c.split() for c in RECORD.split(", "))])


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that index rows name, read from the archives and checked (see RECORD); ValueError for a torn or foreign record.

    payload is null for revisits; see payloads.
    """
    spark = index.sparkSession
    prepare(spark)
    size = index.agg(F.sum("length")).first()[0] or 0
    # index rows are few bytes for what they cost, so the number of parts is fixed here, not left to their size
    parts = max(1, min(-(-size // STRETCH) * 2, 1 << 16), spark.sparkContext.defaultParallelism)
    dealt = index.repartition(parts, "file", F.expr(f"offset div {min(STRETCH, max(1, -(-size // (4 * parts))))}")).sortWithinPartitions("file", "offset")
    return dealt.select("file", "offset", "length", "row_id", "url", "record_type", "refers_to", "digest").mapInArrow(_reader(folder, with_payload), RECORD)


def payloads(index: DataFrame, selected: DataFrame, folder: str) -> DataFrame:
    """(row_id, payload) of selected index rows; revisits get the payload of the response that they refer to, read once for all of them."""
    holders = index.where("record_type = 'response'")
    own = read_records(selected.where("record_type = 'response'"), folder).select("row_id", "payload")
    again = selected.where("record_type = 'revisit'").select("row_id", "digest")
    needed = holders.where(F.col("payload_bytes") > 0).join(again.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])
    found = read_records(needed, folder).select(F.col("payload_digest").alias("digest"), "payload")
    return own.unionByName(again.join(found, "digest").select("row_id", "payload"))
