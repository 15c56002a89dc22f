"""WARC archives with an index of records and reads by byte range."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import group_salted, materialize, salt_of, shared_path

#: A file is closed and the next begun once it holds this many bytes.
FILE_BYTES = 64 << 20
#: Ranges of one file are read together if at most this many bytes lie between them, up to a total.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Profile of revisit records for identical payloads, as the format fixes it.
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Characters of a URL that stay; all others, line ends among them, are percent-encoded.
SAFE = "!#$%&'()*+,/:;=?@[]~"

INDEX = "file string, offset long, length long, url string, digest string, record_type string, page_id long"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _block_digest(block: bytes) -> str:
    return f"WARC-Block-Digest: sha1:{digest_of(block)}"


def _member(head: list[str], block: bytes) -> bytes:
    """A record of the header lines and the block, as its own gzip member."""
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def info_record(name: str, date: str) -> bytes:
    """The record that a file begins with: what it is and who wrote it."""
    block = b"software: auditmill\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", _block_digest(block), "Content-Type: application/warc-fields"]
    return _member(head, block)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, revisit: bool, date: str) -> tuple[bytes, str]:
    """One record as its own gzip member, and the payload's digest. A revisit names the record that has the payload.

    The block is an HTTP response: its head, then the payload; that of a revisit ends with the head.
    """
    digest = digest_of(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, url, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {quote(url or '', safe=SAFE)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        _block_digest(block),
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += [
            f"WARC-Profile: {REVISIT}",
            f"WARC-Refers-To: {record_id(refers_to, refers_url, digest)}",
            f"WARC-Refers-To-Target-URI: {quote(refers_url or '', safe=SAFE)}",
            f"X-Refers-To-Page-Id: {refers_to}",
        ]
    return _member(head, block), digest


def parse(member: bytes) -> dict:
    """The fields of one record, from its gzip member.

    Length and digest of a response are made from the payload that was read; a digest that differs
    from the header's is an error. A revisit has no payload: they are its header's. URLs come
    back as written, with spaces and controls percent-encoded.
    """
    plain = zlib.decompress(member, 31)
    head, _, rest = plain.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    _, _, body = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if fields.get(name) else None
    said = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    response = fields["WARC-Type"] == "response"
    if response and digest_of(body) != said:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    return {
        "page_id": number("X-Page-Id"),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": len(body) if response else number("X-Payload-Length"),
        "payload_digest": said,
        "refers_to": number("X-Refers-To-Page-Id"),
        "payload": body if response else None,
    }


def _writer(folder: str, date: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= file_bytes:
                    if out is not None:
                        out.close()
                    # The name is new for each attempt: what a lost attempt wrote is never in the index.
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    at = out.write(info_record(name, date))
                member, digest = record(r["page_id"], r["url"], r["payload"], r["keep"], r["keep_url"], r["revisit"], date)
                out.write(member)
                rows.append((f"{folder}/{name}", at, len(member), r["url"], digest, "revisit" if r["revisit"] else "response", r["page_id"]))
                at += len(member)
            if out is not None:
                out.flush()
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in INDEX.split(", ")]
            )
        if out is not None:
            out.close()

    return run


def write_warc(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_revisit_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write a record for every row of pages to .warc.gz files in folder; return their index.

    The payload is the html in UTF-8; null counts as empty. Of rows with equal payloads of at
    least min_revisit_bytes, the one with the largest id is a response and the others are
    revisits of it; rows that repeat that id are responses too, and a row with a null id is
    one only if no other row has its payload. Smaller payloads are all responses.

    Equal payloads meet as digests, first in parts of each digest and then as one row a part, so
    a payload of any number of rows is dealt over many tasks. Each record is a gzip member of
    its own; the index has file, offset, length, url and digest for each. A file begins with a warcinfo record,
    which the index leaves out.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("sha"),
        salt_of(F.col(id_col)).alias("salt"),
    )
    digests = rows.where(F.length("payload") >= min_revisit_bytes).select("page_id", "url", "sha", "salt")
    keeps = group_salted(digests, ["sha"], "salt", {"hi": F.max(F.struct("page_id", "url"))}, {"k": F.max("hi")})
    keeps = materialize(keeps.select("sha", "salt", F.col("k.page_id").alias("keep"), F.col("k.url").alias("keep_url")), "keeps")
    large = F.length("payload") >= min_revisit_bytes
    joined = rows.join(keeps, ["sha", "salt"], "left").select(
        "page_id", "url", "payload", "keep", "keep_url", (large & ~F.col("page_id").eqNullSafe(F.col("keep"))).alias("revisit")
    )
    return materialize(joined.mapInArrow(_writer(folder, date, file_bytes), INDEX), "index")


def _reader(gap: int, most: int, with_payload: bool):
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]

    def packed(found: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, opened = None, ""
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                end, stop = at + 1, offsets[at] + lengths[at]
                while end < len(files) and files[end] == files[at] and offsets[end] - stop <= gap and offsets[end] + lengths[end] - offsets[at] <= most:
                    stop = max(stop, offsets[end] + lengths[end])
                    end += 1
                if opened != files[at]:
                    fs, path = pafs.FileSystem.from_uri(files[at])
                    source, opened = fs.open_input_file(path), files[at]
                chunk = source.read_at(stop - offsets[at], offsets[at])
                found = []
                for k in range(at, end):
                    start = offsets[k] - offsets[at]
                    one = parse(chunk[start : start + lengths[k]])
                    if not with_payload:
                        one["payload"] = None
                    found.append(one)
                yield packed(found)
                at = end

    return run


def read_warc(selected: DataFrame, parts: int, gap: int = GAP_BYTES, most: int = READ_BYTES, with_payload: bool = True) -> DataFrame:
    """The records of the selected index rows, read by sorted byte ranges that are coalesced."""
    order = [F.col("file"), F.col("offset")]
    ranged = selected.select("file", "offset", "length").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return ranged.mapInArrow(_reader(gap, most, with_payload), RECORD)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write all pages to the shared folder, index them and read every record back by the index."""
    spark = pages.sparkSession
    index = write_warc(pages, shared_path(spark, "warc"), **options)
    total = index.agg(F.sum("length")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (32 << 20) + 1)
    return read_warc(index, parts, with_payload=False)
