"""Deterministic sharded WARC writer and its reader.

Pages are range-sorted by page_id into shards whose bounds follow from the rows alone. A shard's task writes gzip
members, one per record, rolls to the next file once a file's compressed size passes a limit, regenerates every header
and digest from the payload, and renames a file from a temporary name when it is complete. The manifest is written
last, through a temporary name as well; files that it doesn't list are no part of the archive. Equal input gives equal
bytes, so lost and repeated attempts do no harm.

Records with equal payloads: the one with the largest page_id is a ``response``, the others are ``revisit`` records
that refer to it. Payloads below ``min_revisit_bytes`` are always responses.

Defined cases: a null html is an empty payload; a null url becomes ``about:blank``; white space and control characters
in a url are percent-encoded in the header; a null page_id sorts first and is neither referred to nor a revisit; rows that repeat a page_id are all
written, and among equal payloads of one page_id all but one refer to their own id; an empty table gives a manifest of
no files; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import cut, filesystem, map_arrow, range_shards

#: Payload bytes per shard, at least, and the share of a shard's payload bytes that a file's compressed bytes pass
#: before the next file is begun.
SHARD_BYTES, FILE_SHARE = 16 << 20, 16
#: WARC-Date of every record unless the caller gives one: a fixed value keeps the archive deterministic.
DATE = "2024-01-01T00:00:00Z"
LEVEL = 6
MANIFEST = "shard int, seq int, file string, records long, bytes long, first_id long, last_id long, sha1 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def gzip_member(data: bytes) -> bytes:
    """A gzip member without name and time, so that equal data give equal bytes."""
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(data) + press.flush()


def record_id(namespace: str, page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{namespace}/{page_id}')}>"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def clean_url(url: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "about:blank")


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """The bytes of one WARC/1.1 record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id('page', page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean_url(url)}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_id('page', refers_to)}",
            f"X-Refers-To-Page-ID: {refers_to}",
        ]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The row of RECORD for a record's bytes; a digest that doesn't fit fails."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("no WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}" or kind == "response" and digest != sha1_base32(payload):
        raise ValueError(f"digest of {fields['WARC-Record-ID']} doesn't fit")
    number = lambda k: int(fields[k]) if k in fields else None
    return {
        "page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest,
        "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None,
    }


def revisits(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """page_id, sha1 (hex), last: for the records that a later page_id with an equal payload makes revisits. Digests
    and lengths stand in for payloads, so that equal ones meet without being moved; a hot payload is reduced to its
    largest id before the shuffle, and only payloads that occur more than once are joined back."""
    payload = F.coalesce("html", F.lit(""))
    slim = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    known = slim.where(F.col("page_id").isNotNull() & (F.col("n") >= min_revisit_bytes))
    twice = known.groupBy("sha1", "n").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    return known.join(twice, ["sha1", "n"]).where("page_id < last").select("page_id", "sha1", "last").distinct()


def write_warc(pages: DataFrame, out_dir: str, min_revisit_bytes: int = 0, file_bytes: int | None = None, date: str = DATE) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files below ``out_dir``; returns the manifest, a row per file. Files
    are rolled at ``file_bytes``, by default a share of a shard, which grows with the input."""
    spark = pages.sparkSession
    fs, path = filesystem(out_dir)
    fs.create_dir(path, recursive=True)
    size = F.octet_length(F.coalesce("html", F.lit(""))) + 512
    shard_of, n, shard_bytes = range_shards(pages, "page_id", size, SHARD_BYTES)
    file_bytes = file_bytes or shard_bytes // FILE_SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out_dir)
        out, temp, shard, seq, at, count, first, last, whole = None, "", None, 0, 0, 0, None, None, None
        done, latest, seen, of = [], {}, set(), None

        def close() -> None:
            nonlocal out, seq
            out.close()
            name = f"pages-{shard:06d}-{seq:04d}.warc.gz"
            fs.move(temp, f"{path}/{name}")
            done.append((shard, seq, name, count, at, first, last, whole.hexdigest()))
            out, seq = None, seq + 1

        for batch in batches:
            for s, page_id, url, payload, sha1, later in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if page_id != of:
                    latest, seen, of = {}, set(), page_id
                if payload is None:  # comes before the pages of its id
                    latest[sha1] = later
                    continue
                digest = hashlib.sha1(payload).hexdigest()
                refers_to = latest.get(digest)
                if page_id is not None and refers_to is None and len(payload) >= min_revisit_bytes:
                    refers_to = page_id if digest in seen else None
                    seen.add(digest)
                if out and (s != shard or at >= file_bytes):
                    close()
                if s != shard:
                    shard, seq = s, 0
                if out is None:
                    temp = f"{path}/.tmp-{s:06d}-{seq:04d}-{uuid.uuid4().hex}"
                    out, at, count, first, whole = fs.open_output_stream(temp, compression=None), 0, 0, page_id, hashlib.sha1()
                member = gzip_member(build_record(page_id, url, payload, refers_to, date))
                out.write(member)
                whole.update(member)
                at, count, last = at + len(member), count + 1, page_id
        if out:
            close()
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names)

    html = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(shard_of.alias("shard"), "page_id", "url", html.alias("payload"), F.lit(None).cast("string").alias("sha1"), F.lit(None).cast("long").alias("last"))
    marks = revisits(pages, min_revisit_bytes).select(shard_of.alias("shard"), "page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "sha1", "last")
    placed = rows.unionByName(marks).repartitionById(n, F.col("shard"))
    placed = placed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("sha1").asc_nulls_last(), "url", "payload")
    files = cut(map_arrow(placed, run, MANIFEST))
    files.coalesce(1).sortWithinPartitions("shard", "seq").write.mode("overwrite").parquet(f"{out_dir}/manifest")
    for info in fs.get_file_info(pafs.FileSelector(path)):  # what failed attempts have left
        if info.base_name.startswith(".tmp-"):
            fs.delete_file(info.path)
    total = files.agg(F.count("*").alias("files"), F.sum("records").alias("records"), F.sum("bytes").alias("bytes")).first()
    with fs.open_output_stream(f"{path}/.tmp-summary") as f:
        f.write(json.dumps(total.asDict()).encode())
    fs.move(f"{path}/.tmp-summary", f"{path}/summary.json")
    return spark.read.parquet(f"{out_dir}/manifest")


def read_warc(spark: SparkSession, out_dir: str) -> DataFrame:
    """The records of the files that the manifest of ``out_dir`` lists, as RECORD; a file whose size or digest isn't
    the manifest's fails the read."""
    manifest = spark.read.parquet(f"{out_dir}/manifest").select("file", "bytes", "sha1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out_dir)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name, size, digest in zip(*(batch.column(i).to_pylist() for i in range(3))):
                whole, rows, held, data, parts = hashlib.sha1(), [], 0, b"", []
                unzip = zlib.decompressobj(31)
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    while data or (data := f.read(1 << 20)):
                        if not unzip.eof:
                            parts.append(unzip.decompress(data))
                            whole.update(data[: len(data) - len(unzip.unused_data)])
                            data = unzip.unused_data
                        if unzip.eof:
                            row = parse_record(b"".join(parts))
                            rows.append(row)
                            held += len(row["payload"] or b"") + 200
                            unzip, parts = zlib.decompressobj(31), []
                            if held > 8 << 20:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                if parts or whole.hexdigest() != digest:
                    raise ValueError(f"{name}: damaged archive")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return map_arrow(manifest.repartition(max(1, min(manifest.count(), 100_000)), "file"), run, RECORD)
