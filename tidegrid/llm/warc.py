"""WARC archives: a writer with revisit records, and a reader that splits files at any byte.

Method of the reader: a task gets a byte range of a file and scans it for the gzip magic; a candidate
counts as a member only if its first bytes decompress to a WARC header.  A task owns the records
that start in its range and reads the last one to its end beyond it, so every record is read once.
(An archive that lies uncompressed inside a payload looks like records to a range that begins inside it.)
"""

from __future__ import annotations

import datetime
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from tidegrid.sources.tables import materialise

#: Payloads below this many bytes are always written in full.
LEAST_REVISIT = 1000
#: Bytes after which a writer begins another file; bytes of a reader's range; bytes read at a time.
FILE_BYTES, SPLIT_BYTES, READ_BYTES = 64 << 20, 8 << 20, 1 << 18
# Fixed values of the formats.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1"
RECORD_ID = "<urn:page:%d>"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FILES = "path string, bytes bigint, records bigint"
RECORDS = (
    "page_id bigint, uri string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, "
    "digest_ok boolean, html string"
)


def _storage(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI (file, hdfs, s3, gs, ...) and the path in it."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def originals(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest and refers_to (the page whose payload it repeats, or null).

    Sizes and largest ids are summed per digest before anything moves, and only digests that occur
    more than once are joined back; the join splits the partitions of a hot digest.
    """
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    keyed = pages.select("page_id", "url", "html").withColumns({"payload_bytes": F.octet_length(html).cast("long"), "payload_digest": F.sha1(html)})
    repeated = (
        keyed.where(F.col("payload_bytes") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("payload_digest").alias("repeated_digest"), "first_id")
    )
    joined = keyed.join(repeated, F.col("payload_digest") == F.col("repeated_digest"), "left")
    again = F.when(F.col("first_id") != F.coalesce("page_id", F.lit(-(2**63))), F.col("first_id"))
    return joined.select("page_id", "url", "html", "payload_bytes", "payload_digest", again.alias("refers_to"))


def _record(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to is not None else http + payload
    headers = [
        ("WARC-Type", "revisit" if refers_to is not None else "response"),
        ("WARC-Record-ID", RECORD_ID % page_id if page_id is not None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, digest)}>"),
        ("WARC-Date", datetime.datetime.fromtimestamp(0, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Length", str(len(block))),
    ]
    if url:
        headers.insert(2, ("WARC-Target-URI", "".join(url.split())))
    if refers_to is not None:
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", RECORD_ID % refers_to)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers).encode() + b"\r\n"
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


def write(pages: DataFrame, folder: str, least: int = LEAST_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of all ``pages`` (page_id, url, html; others are ignored) in ``folder``; their table of files.

    Null html is an empty payload, a null id gets a record id of its content, a null url no target.  A
    task names its files anew each time it runs; the table, written by Spark's commit, has those of the
    attempt that counts, so what lost or repeated tasks leave behind is never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _storage(folder)
        store.create_dir(top, recursive=True)
        done, out, name, size, records = [], None, "", 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top}/{name}", compression=None)
                payload = b"" if row["refers_to"] is not None else (row["html"] or "").encode()
                member = _record(row["page_id"], row["url"], payload, row["payload_bytes"], row["payload_digest"], row["refers_to"])
                out.write(member)
                size, records = size + len(member), records + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, records))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, records))
        columns = list(zip(*done)) or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "bytes", "records"])

    named = originals(pages, least)
    # a revisit needs no payload
    slim = named.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")))
    return materialise(slim.mapInArrow(run, FILES))


class _Member:
    """One gzip member, decompressed piece by piece from an open file."""

    def __init__(self, file, start: int):
        self.file, self.at = file, start
        self.unpack = zlib.decompressobj(31)

    def read(self, limit: int = READ_BYTES) -> bytes:
        """Some more bytes, none at the end of the member."""
        while not self.unpack.eof:
            packed = self.unpack.unconsumed_tail
            if not packed:
                self.file.seek(self.at)
                packed = self.file.read(READ_BYTES)
                if not packed:
                    raise EOFError("a gzip member has no end")
                self.at += len(packed)
            plain = self.unpack.decompress(packed, limit)
            if plain:
                return plain
        return b""

    def end(self) -> int:
        return self.at - len(self.unpack.unused_data)


def _header(member: _Member) -> tuple[dict[str, str], bytes] | None:
    """WARC header fields (names in lower case) and what of the block came with them; None if there is none."""
    head = b""
    try:
        while b"\r\n\r\n" not in head:
            more = member.read(4096)
            head += more
            if not more or not head.startswith(b"WARC/"[: len(head)]) or len(head) > 1 << 20:
                return None
    except (zlib.error, EOFError):
        return None
    head, _, rest = head.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}, rest


def _page(record_id: str) -> int | None:
    before, after = RECORD_ID.split("%d")
    inner = record_id[len(before) : -len(after)] if record_id.startswith(before) else ""
    return int(inner) if inner.lstrip("-").isdigit() else None


def _read_record(fields: dict[str, str], rest: bytes, member: _Member, keep: bool) -> tuple:
    """The row of a record; its payload passes through piece by piece."""
    left = int(fields["content-length"])
    http, payload = b"", io.BytesIO() if keep else None
    sha, size, in_body = hashlib.sha1(), 0, False
    while left > 0:
        piece = rest or member.read()
        rest = b""
        if not piece:
            raise EOFError("a record ends before its length")
        piece = piece[:left]
        left -= len(piece)
        if not in_body:
            http += piece
            if b"\r\n\r\n" not in http:
                continue
            http, _, piece = http.partition(b"\r\n\r\n")
            in_body = True
        sha.update(piece)
        size += len(piece)
        if payload is not None:
            payload.write(piece)
    while member.read():
        pass
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    http_fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("utf-8", "replace").split("\r\n")[1:])}
    page, uri = _page(fields["warc-record-id"]), fields.get("warc-target-uri")
    if fields["warc-type"] == "revisit":
        return page, uri, "revisit", _page(fields["warc-refers-to"]), int(http_fields["content-length"]), stated, True, None
    digest = sha.hexdigest()
    text = payload.getvalue().decode("utf-8", "replace") if payload is not None else None
    return page, uri, fields["warc-type"], None, size, digest, digest == stated, text


def read_range(path: str, start: int, stop: int, keep: bool = False) -> Iterator[tuple]:
    """The records of one file whose gzip member starts in [start, stop)."""
    store, inner = _storage(path)
    with store.open_input_file(inner) as file:
        at = start
        while at < stop:
            file.seek(at)
            window = file.read(min(READ_BYTES, stop - at) + len(MAGIC) - 1)
            found = window.find(MAGIC)
            if found < 0:
                at += max(1, len(window) - len(MAGIC) + 1)
                continue
            at += found
            if at >= stop:
                return
            member = _Member(file, at)
            header = _header(member)
            if header is None:
                at += 1
                continue
            yield _read_record(*header, member, keep)
            at = member.end()


def read(files: DataFrame, keep_payload: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of a table of files (path, bytes), from byte ranges that tasks read on their own.

    A range without a record start gives no rows; an empty table or file gives none either.  A payload
    is kept only on request; its size and digest are taken while it streams by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
            + [("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("digest_ok", pa.bool_()), ("html", pa.string())]
        )
        rows, held = [], 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            for part in batch.to_pylist():
                for row in read_range(part["path"], part["start"], part["stop"], keep_payload):
                    rows.append(row)
                    held += len(row[-1] or "") + 200
                    if held >= 1 << 22:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    starts = F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(split_bytes)))
    ranges = files.where("bytes > 0").select("path", "bytes", starts.alias("start"))
    ranges = ranges.withColumn("stop", F.least(F.col("bytes"), F.col("start") + split_bytes)).drop("bytes")
    # a range is a tiny row but much work: one task each, which adaptive execution must not merge
    n = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    return ranges.repartition(int(n)).mapInArrow(run, RECORDS)


SQL = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), r AS (
  SELECT payload_digest AS d, max(page_id) AS first_id FROM p WHERE payload_bytes >= 1000 GROUP BY 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM p LEFT JOIN r ON payload_digest = d
"""
