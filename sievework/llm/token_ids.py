"""Token ids in binary files.

Documents are encoded with a public tokenizer, an end id is appended, and the ids are written in ascending document
order into shard files. One zstandard dictionary, trained on serialized id arrays of a bounded sample, is shared by all
files; each document is a compressed frame of its own, so that a short document is read without its neighbours. A file
holds the SHA-256 of the dictionary and an index of offsets.

File layout (little-endian)::

    magic 8s | bytes per id u16 | sha256 of the dictionary 32s | frames | index | footer
    index:  documents x (doc_id i64, has_id u8, offset u64, bytes u32, ids u64)
    footer: index offset u64 | documents u64 | crc32 of the index u32 | magic 8s

A file is written under a temporary name and renamed once complete; equal input gives equal bytes, so a repeated
attempt replaces a file by itself. Defined cases: a null text counts as empty and yields the end id alone; a null
doc_id sorts first; rows that repeat a doc_id are kept and ordered among themselves by their ids; an empty table gives
no file and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.llm.bpe import BATCH, Coder
from sievework.llm.shared import cut, filesystem, map_arrow, range_shards, take_room

MAGIC = b"SWTOK001"
HEAD, FOOT = "<8sH32s", "<QQI8s"
HEAD_SIZE, FOOT_SIZE = struct.calcsize(HEAD), struct.calcsize(FOOT)
INDEX = [("doc_id", "<i8"), ("has_id", "u1"), ("offset", "<u8"), ("bytes", "<u4"), ("ids", "<u8")]
#: The dictionary: documents of the sample, longest text taken into it, bytes of the dictionary.
SAMPLE_DOCS, SAMPLE_CHARS, DICT_BYTES = 256, 8_000, 64 * 1024
#: Text bytes per shard and compressed bytes per file.
SHARD_BYTES, FILE_BYTES = 32 << 20, 64 << 20
LEVEL = 3
#: Bytes of words and chunks that a worker remembers.
ROOM = (96 << 20, 96 << 20)

_encoders: dict[str, "Encoder"] = {}


class Encoder:
    """Encodes texts with the library's model; ``width`` is the bytes per id."""

    def __init__(self, path: str):
        self.coder = Coder(path, library=True, room=ROOM)
        self.width = 2 if len(self.coder.merger.tokens) <= 1 << 16 else 4

    def encode(self, texts: list[bytes]) -> list[bytes]:
        packed = self.coder.encode(texts)
        return packed if self.width == 4 else [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in packed]


def encoder(path: str) -> Encoder:
    take_room("token_ids", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_ids(docs: DataFrame, tokenizer_path: str, end_id: int | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``ids``: the token ids of its ``text``, packed, with ``end_id`` at the end."""
    schema = docs.select(*keep).withColumn("ids", F.lit(b"")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        end = b"" if end_id is None else int(end_id).to_bytes(enc.width, "little")
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                ids = pa.array([x + end for x in enc.encode(texts)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), ids], [*keep, "ids"])

    return map_arrow(docs.select(*keep, F.col("text").cast("binary").alias("text")), run, schema)


def train_dictionary(docs: DataFrame, tokenizer_path: str) -> bytes:
    """Dictionary from the ids of the SAMPLE_DOCS documents of least hash that have at most SAMPLE_CHARS characters;
    empty if they are too few to train on."""
    import zstandard

    short = docs.where((F.length("text") > 0) & (F.length("text") <= SAMPLE_CHARS)).select("text", F.xxhash64("doc_id", "text").alias("h"))
    # documents of a hash below a limit that four times the sample is expected to pass, long ones among them; equal rows
    # are one
    share = min(1.0, 4 * SAMPLE_DOCS / max(1, docs.count()))
    few = short.where(F.shiftrightunsigned("h", 24) < max(1, int(share * (1 << 40)))).groupBy("h").agg(F.min("text").alias("text"))
    rows = few.orderBy("h").limit(SAMPLE_DOCS).collect()
    ids = encoder(tokenizer_path).encode([r["text"].encode() for r in rows])
    if len(ids) < 50 or sum(map(len, ids)) < 16 * 1024:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, sum(map(len, ids)) // 8), ids, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return (
        zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_content_size=True),
        zstandard.ZstdDecompressor(dict_data=shared),
    )


def write_token_files(docs: DataFrame, out_dir: str, tokenizer_path: str, end_id: int) -> DataFrame:
    """Write ``docs`` (doc_id, text) below ``out_dir`` and return the manifest, a row per file in order, with the
    number of ids in all earlier files as ``start``."""
    import hashlib
    import uuid

    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer_path)
    key = hashlib.sha256(dictionary).digest()
    fs, path = filesystem(out_dir)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/dictionary.tmp") as f:
        f.write(dictionary)
    fs.move(f"{path}/dictionary.tmp", f"{path}/dictionary-{key.hex()}")
    shard_of, n, _ = range_shards(docs, "doc_id", F.octet_length(F.coalesce("text", F.lit(""))) + 64, SHARD_BYTES)
    coded = encode_ids(docs.select("doc_id", "text", shard_of.alias("shard")), tokenizer_path, end_id, ("shard", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out_dir)
        press = _codec(dictionary)[0]
        width = encoder(tokenizer_path).width
        out, rows, index, done = None, 0, [], []
        shard = seq = at = ids = 0
        temp = ""

        def close() -> None:
            nonlocal out, seq, index
            table = np.array(index, dtype=INDEX).tobytes()
            out.write(table)
            out.write(struct.pack(FOOT, at, len(index), zlib.crc32(table), MAGIC))
            out.close()
            name = f"ids-{shard:06d}-{seq:04d}.swtok"
            fs.move(temp, f"{path}/{name}")
            done.append((shard, seq, name, len(index), ids, at + len(table) + FOOT_SIZE))
            out, seq, index = None, seq + 1, []

        for batch in batches:
            for s, doc, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out and (s != shard or at >= FILE_BYTES):
                    close()
                if s != shard:
                    shard, seq = s, 0
                if out is None:
                    temp = f"{path}/.tmp-{s:06d}-{seq:04d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(temp)
                    out.write(struct.pack(HEAD, MAGIC, width, key))
                    at, ids = HEAD_SIZE, 0
                frame = press.compress(data)
                out.write(frame)
                index.append((doc or 0, doc is not None, at, len(frame), len(data) // width))
                at += len(frame)
                ids += len(data) // width
        if out:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("shard", "seq", "file", "docs", "ids", "bytes"), x)) for x in done], MANIFEST)

    placed = coded.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    files = cut(map_arrow(placed, run, "shard int, seq int, file string, docs long, ids long, bytes long"))
    before = Window.orderBy("shard", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/manifest")
    return spark.read.parquet(f"{out_dir}/manifest")


MANIFEST = pa.schema([("shard", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def read_token_files(spark: SparkSession, out_dir: str) -> DataFrame:
    """What the files of ``out_dir`` hold: doc_id, start (ids before the document), n_tokens and ``ids`` as packed
    unsigned 32-bit integers. A wrong magic, dictionary or index checksum fails the read."""
    import hashlib

    manifest = spark.read.parquet(f"{out_dir}/manifest")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(out_dir)
        codecs: dict[bytes, object] = {}
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(f"{path}/{name}") as f:
                    magic, width, key = struct.unpack(HEAD, f.read(HEAD_SIZE))
                    f.seek(f.size() - FOOT_SIZE)
                    at, n, crc, end = struct.unpack(FOOT, f.read(FOOT_SIZE))
                    f.seek(at)
                    raw = f.read(f.size() - FOOT_SIZE - at)
                    if magic != MAGIC or end != MAGIC or zlib.crc32(raw) != crc:
                        raise ValueError(f"{name}: damaged token file")
                    if key not in codecs:
                        with fs.open_input_file(f"{path}/dictionary-{key.hex()}") as d:
                            dictionary = d.read()
                        if hashlib.sha256(dictionary).digest() != key:
                            raise ValueError(f"{name}: damaged dictionary")
                        codecs[key] = _codec(dictionary)[1]
                    index = np.frombuffer(raw, dtype=INDEX)
                    before = start + np.concatenate([[0], np.cumsum(index["ids"])[:-1]]).astype(np.int64)
                    f.seek(HEAD_SIZE)
                    for i in range(0, n, 512):
                        part = index[i : i + 512]
                        block = f.read(int(part["bytes"].sum()))
                        cuts = np.concatenate([[0], np.cumsum(part["bytes"])]).astype(int)
                        ids = [codecs[key].decompress(block[a:b]) for a, b in zip(cuts, cuts[1:])]
                        if width == 2:
                            ids = [np.frombuffer(x, "<u2").astype("<u4").tobytes() for x in ids]
                        doc = pa.array(part["doc_id"].astype(np.int64), mask=part["has_id"] == 0)
                        yield pa.RecordBatch.from_arrays([doc, pa.array(before[i : i + 512]), pa.array(part["ids"].astype(np.int64)), pa.array(ids, pa.binary())], schema=schema)

    tasks = manifest.select("file", "start").repartition(max(1, min(manifest.count(), 100_000)), "file")
    return map_arrow(tasks, run, "doc_id long, start long, n_tokens long, ids binary")
