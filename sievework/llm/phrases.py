"""Phrase collocation mining.

Texts are split into pieces at punctuation, and equal pieces of a language become one with a multiplicity. Tasks count
the weighted n-grams of some FLUSH_WORDS words of distinct pieces, and deal them by a hash to buckets as compressed
blobs. Each bucket is counted by duckdb under a memory limit, out of core beyond it, and only n-grams seen LEAST times
or more go on: parts of a frequent phrase are frequent too. So words and pairs are counted first, and longer n-grams
only where all their pairs are in a bitmap of the frequent ones; the bitmap's size is bound, and what it lets through by
chance costs time and changes no count. Every candidate then asks for the counts of its parts; requests are shuffled to
the counts by (lang, part), and the answers back to their phrase.

Defined cases: a null or blank text has no words; a null lang is ``und``; a document counts as often as its row is
repeated; doc_ids, null or repeated, play no part; an empty table gives no rows; other columns are ignored. Counts are
exact 64-bit numbers; scores are found in decimals.
"""

from __future__ import annotations

import contextlib
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.merkle import lower_ascii, numbered
from sievework.llm.shared import fresh_dir, map_arrow, partitions
from sievework.llm.shingles import mixed
from sievework.shipping import ship

LONGEST, LEAST, TOP, INSIDE_PERCENT, SCALE = 4, 30, 2000, 80, 2_000_000
#: Words that a task counts at once, n-grams that a bucket gets on average at most, and duckdb's memory.
FLUSH_WORDS, BUCKET_GRAMS, MEMORY = 1 << 20, 6_000_000, "400MB"
#: Bits of the bitmap at most (32 MB, broadcast), and of each slice of it that a task makes.
BITMAP_BITS, SLICE_BITS = 1 << 28, 1 << 20
_GRAMS = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("f", pa.int64())])


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    out = fresh_dir(df.sparkSession, kind)
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def pieces(docs: DataFrame) -> DataFrame:
    """lang, piece (words joined by a space), m: the distinct pieces and how often they occur."""
    text = F.regexp_replace(lower_ascii(F.col("text")), r"[\x20\x09]+", " ")
    piece = F.explode(F.split(text, r"[.,;:!?\x0A-\x0D]")).alias("piece")
    rows = docs.where(F.col("text").isNotNull()).select(F.coalesce("lang", F.lit("und")).alias("lang"), piece)
    return rows.select("lang", F.btrim("piece", F.lit(" ")).alias("piece")).where("piece <> ''").groupBy("lang", "piece").agg(F.count("*").alias("m"))


def _weighted(inverse: np.ndarray, size: int, weight: np.ndarray) -> np.ndarray:
    out = np.zeros(size, np.int64)
    np.add.at(out, inverse, weight)
    return out


def _named_hashes(langs: list[str], lang: np.ndarray, words: list[str], word: np.ndarray) -> np.ndarray:
    """A hash of each (lang, word), given as places in ``langs`` and ``words``."""
    import xxhash

    seeds = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in langs), np.uint64, len(langs))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return mixed(hashes[word] ^ seeds[lang])


def _longer(before: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of all words but the last and that of the last."""
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + last)


def _in_bitmap(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _grams(held: list[pa.RecordBatch], lengths: range, pairs: np.ndarray | None) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]]:
    """For each of ``lengths`` the distinct n-grams of pieces: langs, phrases, weights and hashes. Where ``pairs`` is
    given, only n-grams whose pairs are all in that bitmap."""
    table = pa.Table.from_batches(held).combine_chunks()
    langs = table.column("lang").combine_chunks().dictionary_encode()
    split = pc.split_pattern(table.column("piece").combine_chunks(), " ")
    sizes = pc.list_value_length(split).to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)  # n-grams in order of their words compress well
    place = np.empty(len(order), np.int64)
    place[order.to_numpy()] = np.arange(len(order))
    vocabulary = coded.dictionary.take(order)
    codes, row = place[coded.indices.to_numpy()], np.repeat(np.arange(len(sizes)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(row))  # words from here to the piece's end
    weight, lang_of = table.column("m").to_numpy()[row], langs.indices.to_numpy().astype(np.int64)[row]
    first, word = np.unique(lang_of * len(vocabulary) + codes, return_inverse=True)
    spoken, spelt = first // len(vocabulary), first % len(vocabulary)
    names, one = vocabulary.take(pa.array(spelt)), _named_hashes(langs.dictionary.to_pylist(), spoken, vocabulary.to_pylist(), spelt)
    at, gram, phrases, hashed = np.arange(len(row)), word, names, one
    for n in range(1, lengths.stop):
        if n > 1:
            keep = left[at] >= n
            if n > 2 and pairs is not None:
                keep &= follows[at + n - 2]
            at = at[keep]
            keys, gram = np.unique(gram[keep] * len(first) + word[at + n - 1], return_inverse=True)
            before, last = keys // len(first), keys % len(first)
            hashed, spoken = _longer(hashed[before], one[last]), spoken[before]
            if n == 2 and pairs is not None:
                known = _in_bitmap(hashed, pairs)[gram]
                follows = np.zeros(len(row) + 1, bool)  # whether a frequent pair begins here
                follows[at] = known
                at, gram = at[known], gram[known]
            phrases = pc.binary_join_element_wise(phrases.take(pa.array(before)), names.take(pa.array(last)), " ")
        if n >= lengths.start and len(at):
            yield langs.dictionary.take(pa.array(spoken)), phrases, _weighted(gram, len(phrases), weight[at]), hashed


def _blobs(held: list[pa.RecordBatch], buckets: int, lengths: range, pairs: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A blob of n-grams for each bucket."""
    parts: dict[int, list[pa.RecordBatch]] = {}
    for lang, phrase, f, hashed in _grams(held, lengths, pairs):
        bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sorted_ = pa.RecordBatch.from_arrays([lang, phrase, pa.array(f)], schema=_GRAMS).take(pa.array(order))
        found, starts = np.unique(bucket[order], return_index=True)
        for b, start, stop in zip(found.tolist(), starts, [*starts[1:], len(order)]):
            parts.setdefault(b, []).append(sorted_.slice(start, stop - start))
    for b in sorted(parts):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _GRAMS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_table(pa.Table.from_batches(parts.pop(b)).combine_chunks())
        yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["bucket", "grams"])


def _counted(table, least: int):
    """The n-grams of a bucket's blobs whose weights sum to ``least`` or more."""
    import duckdb

    def batches():
        for blob in table.column("grams"):
            with pa.ipc.open_stream(blob.as_buffer()) as stream:
                yield from stream

    folder = tempfile.mkdtemp(prefix="phrases-")  # what duckdb spills, as a shuffle does, while this task runs
    try:
        with contextlib.closing(duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": folder})) as db:
            db.execute("SET preserve_insertion_order = false")
            reader = pa.RecordBatchReader.from_batches(_GRAMS, batches())
            db.register("grams", reader)
            found = db.sql(f"SELECT lang, phrase, CAST(sum(f) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING sum(f) >= {least}").to_arrow_table()
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    from sievework.llm.shared import end_task

    found = found.cast(_GRAMS)
    end_task()
    return found


def frequent(distinct: DataFrame, lengths: range, least: int = LEAST, pairs: Broadcast | None = None) -> DataFrame:
    """lang, phrase, f of the n-grams of ``lengths`` words that occur ``least`` times or more in ``distinct``; ``pairs``
    is a bitmap of the hashes of frequent pairs."""
    words = distinct.agg(F.sum(_words("piece"))).first()[0] or 0
    buckets = max(1, -(-words * len(lengths) // BUCKET_GRAMS), min(words // 1000, partitions(distinct.sparkSession)))
    ship(distinct.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if pairs is None else np.frombuffer(pairs.value, np.uint8)
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows + pc.sum(pc.count_substring(batch.column("piece"), " ")).as_py()
            if size >= FLUSH_WORDS:
                yield from _blobs(held, buckets, lengths, bitmap)
                held, size = [], 0
        if size:
            yield from _blobs(held, buckets, lengths, bitmap)

    def count(table):  # applyInArrow takes a function of a table by its lack of hints
        return _counted(table, least)

    dealt = map_arrow(distinct.select("lang", "piece", "m"), run, "bucket int, grams binary")
    return dealt.groupBy("bucket").applyInArrow(count, "lang string, phrase string, f long")


def bitmap(pairs: DataFrame) -> Broadcast:
    """The hashes of ``pairs`` (lang, phrase) as bits of a table of at most BITMAP_BITS, made slice by slice."""
    spark = pairs.sparkSession
    bits = min(BITMAP_BITS, 1 << max(3, (16 * pairs.count()).bit_length()))
    part = min(bits, SLICE_BITS)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, split = batch.column("lang").dictionary_encode(), pc.split_pattern(batch.column("phrase"), " ")
            words = split.flatten().dictionary_encode()
            lang = langs.indices.to_numpy().astype(np.int64).repeat(2)
            one = _named_hashes(langs.dictionary.to_pylist(), lang, words.dictionary.to_pylist(), words.indices.to_numpy())
            at = (_longer(one[0::2], one[1::2]) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // part), pa.array(at % part)], ["slice", "bit"])

    def made(table):
        flags = np.zeros(max(8, part), bool)
        flags[table.column("bit").to_numpy()] = True
        return pa.table([table.column("slice").slice(0, 1), pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())], ["slice", "bits"])

    placed = map_arrow(pairs.select("lang", "phrase"), place, "slice long, bit long").distinct()
    out = bytearray(max(1, bits // 8))
    for r in placed.groupBy("slice").applyInArrow(made, "slice long, bits binary").collect():
        out[r["slice"] * part // 8 : (r["slice"] + 1) * part // 8] = r["bits"]
    return spark.sparkContext.broadcast(bytes(out))


def _words(column: str):
    return (F.length(column) - F.length(F.replace(column, F.lit(" "))) + 1).cast("long")


def _part(start, length):
    return F.array_join(F.slice("w", start, length), " ")


def outer_counts(candidates: DataFrame) -> DataFrame:
    """lang, phrase, outer: the largest count of a longer candidate in which the words of a phrase lie."""
    longer = candidates.where("size(w) > 2")
    starts = F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("at")
    lengths = F.explode(F.sequence(F.lit(2), F.least(F.size("w") - F.col("at") + 1, F.size("w") - 1))).alias("n")
    inner = longer.select("lang", "w", "a", starts).select("lang", "w", "a", "at", lengths)
    return inner.select("lang", _part(F.col("at"), F.col("n")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("outer"))


def scores(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``candidates`` (lang, phrase, w, a) with l, r and score of their lowest cut."""
    cuts = candidates.select("lang", "phrase", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    parts = F.array(_part(F.lit(1), F.col("k")), _part(F.col("k") + 1, F.size("w")))
    requests = cuts.select("lang", "phrase", "a", "k", F.posexplode(parts).alias("side", "part"))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"]).repartition("lang", "phrase")
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("f")))
    cut_ = answers.groupBy("lang", "phrase", "a", "k").agg(side(0).alias("l"), side(1).alias("r"))
    score = F.expr(f"(CAST({SCALE} AS DECIMAL(18,0)) * CAST(a AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) + CAST(r AS DECIMAL(19,0)))")
    least = cut_.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("c"))
    return least.select("lang", "phrase", "a", "c.l", "c.r", "c.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases."""
    distinct = _stored(pieces(docs), "pieces")
    totals = distinct.groupBy("lang").agg(F.sum(F.col("m") * _words("piece")).alias("n"))
    short = _stored(frequent(distinct, range(1, 3), least), "grams")
    known = bitmap(short.where("phrase LIKE '% %'"))
    counts = short.unionByName(_stored(frequent(distinct, range(3, LONGEST + 1), least, known), "grams"))
    candidates = counts.withColumn("w", F.split("phrase", " ")).where("size(w) > 1").withColumnRenamed("f", "a")
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    open_ = candidates.join(outer_counts(candidates), ["lang", "phrase"], "left")
    open_ = open_.where(F.col("outer").isNull() | (100 * wide("outer") < INSIDE_PERCENT * wide("a"))).drop("outer")
    scored = scores(open_, counts)
    order = {"low": -F.col("score"), "seldom": -F.col("a"), "said": F.col("phrase")}
    ranked = numbered(scored.withColumnRenamed("lang", "group").withColumns(order), list(order)).where(F.col("i") < top)
    ranked = ranked.select(F.col("group").alias("lang"), (F.col("i") + 1).alias("rank"), "phrase", "a", "l", "r", "score")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
