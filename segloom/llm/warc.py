"""WARC archives with an index written first, and byte-range reads of the records that the index selects."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.llm.common import BROADCAST_ROWS, HOT_ROWS, join_counted, scratch_path, stored
from segloom.llm.repeated_spans import bit_filter, passes

#: Bytes of an archive before the next begins; of a run of records that one task reads; between records that are read together.
ARCHIVE_BYTES, SPAN_BYTES, GAP_BYTES, READ_BYTES = 256 << 20, 8 << 20, 64 << 10, 4 << 20
_INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("id", pa.int64())])
INDEX_DDL = "file string, offset long, length long, url string, digest string, record_type string, id long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(page: int | None) -> str:
    return f"<urn:page:{'' if page is None else page}>"


def _page(urn: str) -> int | None:
    value = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(value) if value else None


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> tuple[bytes, str]:
    """One WARC/1.1 record, and its payload digest. A revisit has the HTTP header of the payload that it leaves out."""
    digest = payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(refers_to)}"]
        payload = b""
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return b"".join([b"WARC/1.1\r\n", "\r\n".join(head).encode(), b"\r\n\r\n", http, payload, b"\r\n\r\n"]), digest


def parse(data: bytes) -> dict:
    """The fields of one record; the payload's length and digest are checked where it is there."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]}")
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload does not match its digest")
    return {"id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"], "digest": digest, "payload_bytes": size, "refers_to": _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None, "payload": payload if fields["WARC-Type"] == "response" else None}


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, level: int, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    fs.create_dir(base, recursive=True)
    own = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
    out, at, count, buffer, name = None, 0, 0, bytearray(), ""
    try:
        for batch in batches:
            rows = []
            for page, url, html, refers in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.write(bytes(buffer))
                        out.close()
                    name, at, buffer = f"{own}-{count:03d}.warc.gz", 0, bytearray()
                    out, count = fs.open_output_stream(f"{base}/{name}", compression=None), count + 1
                raw, digest = record(page, url, (html or "").encode(), refers, date)
                packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = packer.compress(raw) + packer.flush()
                rows.append((name, at, len(member), url, digest, "response" if refers is None else "revisit", page))
                buffer += member
                at += len(member)
                if len(buffer) >= READ_BYTES:
                    out.write(bytes(buffer))
                    buffer = bytearray()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)
        if out is not None:
            out.write(bytes(buffer))
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 1, archive_bytes: int = ARCHIVE_BYTES, most: int = BROADCAST_ROWS, hot: int = HOT_ROWS) -> DataFrame:
    """Writes a gzip member per row into archives of ``folder`` (a URI that driver and executors share) and returns the
    index, stored: file, offset, length, url, digest, record_type, id.

    Of rows with equal payloads (the UTF-8 of the html, null: empty) of at least ``min_bytes`` bytes the smallest id is a
    response and the others revisit it. Only digests are grouped, and payloads stay where they are read. If over ``most``
    digests repeat, rows whose digest may be one of them, by a filter of 64 MB at most, go by digest, those of a digest of
    over ``hot`` rows spread by id; all other payloads stay. Repeated rows with the smallest id are all responses, as are rows of a group without
    ids. Each task writes files of its own name, and only files of tasks that ended are in the index, so lost or repeated
    tasks leave no trace. Null urls leave the header out. Other columns are not read; an empty table has an empty index.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha1(F.encode("html", "utf-8"))))
    same = rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    same = stored(same, "payloads")
    refers = F.when((F.octet_length("html") >= min_bytes) & ~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    write = lambda rows: stored(rows.select("id", "url", "html", "refers_to").mapInArrow(lambda it: _write(it, folder, date, level, archive_bytes), INDEX_DDL), "warc_index")
    repeated = same.count()
    if repeated <= most:
        return write(rows.join(F.broadcast(same), "sha", "left").select("*", refers))
    marked = rows.withColumn("h", F.xxhash64("sha"))
    bits = pages.sparkSession.sparkContext.broadcast(bit_filter(same.select(F.xxhash64("sha").alias("h")), repeated))
    side = lambda inside: marked.mapInArrow(lambda it: _sift(it, bits, inside), "id long, url string, html string, sha binary, h long").drop("h")
    alone = write(side(False).withColumn("refers_to", F.lit(None).cast("long")))
    return alone.unionByName(write(join_counted(side(True), same, ["sha"], "id", most, hot).select("*", refers)))


def _sift(batches: Iterator[pa.RecordBatch], bits, inside: bool) -> Iterator[pa.RecordBatch]:
    """The rows whose digest is in the filter, or not."""
    for batch in batches:
        found = passes(bits.value, batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
        yield batch.filter(pa.array(found if inside else ~found))


def _fetch(batches: Iterator[pa.RecordBatch], folder: str, payloads: bool) -> Iterator[pa.RecordBatch]:
    from pyarrow.fs import FileSystem

    fs, base = FileSystem.from_uri(folder)
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), *([("payload", pa.binary())] if payloads else [])])

    def ranges() -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
        name, start, end, inside = None, 0, 0, []
        for batch in batches:
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if inside and (file != name or offset - end > GAP_BYTES or offset + length - start > READ_BYTES):
                    yield name, start, end, inside
                    inside = []
                if not inside:
                    name, start, end = file, offset, offset
                inside.append((offset - start, length))
                end = max(end, offset + length)
        if inside:
            yield name, start, end, inside

    held, source = None, None
    for name, start, end, inside in ranges():
        if name != held:
            if source is not None:
                source.close()
            held, source = name, fs.open_input_file(f"{base}/{name}")
        data = source.read_at(end - start, start)
        got = [parse(gzip.decompress(data[a : a + n])) for a, n in inside]
        yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in got], f.type) for f in schema], schema=schema)
    if source is not None:
        source.close()


def read_records(selected: DataFrame, folder: str, payloads: bool = False, span_bytes: int = SPAN_BYTES) -> DataFrame:
    """The records of the index rows ``selected`` (any subset): id, url, record_type, digest, payload_bytes, refers_to, and
    with ``payloads`` the payload of responses. Rows are dealt by file and stretch of ``span_bytes`` to as many partitions as
    the selected bytes ask for (a sum over the stored index), sorted by offset, and neighbours are fetched with one read each; payloads are checked against their digests."""
    parts = 1 + 2 * (selected.agg(F.sum("length")).first()[0] or 0) // span_bytes
    dealt = selected.withColumn("span", F.expr(f"offset div {span_bytes}")).repartition(parts, "file", "span").sortWithinPartitions("file", "offset")
    ddl = "id long, url string, record_type string, digest string, payload_bytes long, refers_to long" + (", payload binary" if payloads else "")
    return dealt.select("file", "offset", "length").mapInArrow(lambda it: _fetch(it, folder, payloads), ddl)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared folder, as a URI."""
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
