"""Language model scores by stupid backoff, with the corpus itself as the model's text.

Count tables of n-grams of 1 to ORDER words hold a row per n-gram with its count over all documents. They are
partitioned by ranges of the n-gram's hash and joined to the exploded n-grams of the documents; a document's score is
the sum over its words. The relations are moved as blocks of columns: documents fall into blocks by a hash of their id,
a block sends each distinct n-gram once with its count to the n-gram's partition (so that a hot n-gram is a row per
block there), the partition adds the counts up and answers each block in the order of its request, and the block joins
the answers to its documents' n-grams.

A document isn't scored by itself: its own occurrences are taken off every count. With c the counts that are left, N
the words that are left and w[-1] the word before, the score of a word w is the first of

    c(w[-2] w[-1] w) / c(w[-2] w[-1]),  a * c(w[-1] w) / c(w[-1]),  a^2 * c(w) / N,  a^2 / (N + 1)

whose count isn't 0, with a = BACKOFF; at a text's start the longest context there is comes first, without a factor.

Defined cases: words are in ASCII lower case; a null or blank text has no words, log_score 0 and a null mean; a null
doc_id and repeated rows are documents of their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import end_task, map_arrow, words
from sievework.llm.shingles import rolling, word_hashes
from sievework.shipping import ship

ORDER, BACKOFF = 3, 0.4
#: Characters of text per block, and distinct n-grams of an order that a partition gets, about.
BLOCK_CHARS, PART_WORDS = 8 << 20, 1_000_000


def _grams(texts: list[bytes], n: int) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Word counts of the texts; per order from 1 to ``n`` the hash at each word of the n-gram that ends there (0 where
    the text begins too late)."""
    split = [t.lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    flat = [x for w in split for x in w]
    h = word_hashes(flat)
    end_task()
    at = np.arange(len(h)) - np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) if len(sizes) else np.zeros(0, np.int64)
    out = []
    for k in range(1, n + 1):
        g = np.zeros(len(h), np.uint64)
        if len(h) >= k:
            g[k - 1 :] = rolling(h, k)
        out.append(g)
    return out, sizes, [at >= k - 1 for k in range(1, n + 1)]


def _texts(table: pa.Table) -> list[bytes]:
    import zstandard

    plain = zstandard.ZstdDecompressor()
    return [plain.decompress(z) for z in table.column("z").to_pylist()]


def _bounds(parts: int) -> np.ndarray:
    return (np.arange(1, parts, dtype=object) * (1 << 64) // parts).astype(np.uint64)


def _pack(sorted_hashes: np.ndarray) -> bytes:
    """Sorted distinct hashes as a width, the number of differences, the first hash, and the differences in that many
    planes of bytes, lowest first. Differences of hashes are near even but for their highest byte, which is compressed."""
    import zstandard

    steps = np.diff(sorted_hashes)
    width = max(1, -(-int(steps.max()).bit_length() // 8)) if len(steps) else 1
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    head = bytes([width]) + np.uint32(len(steps)).tobytes() + sorted_hashes[:1].tobytes()
    return head + planes[:-1].tobytes() + zstandard.ZstdCompressor(level=1).compress(planes[-1].tobytes())


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    width, n = data[0], int(np.frombuffer(data, np.uint32, 1, 1)[0])
    low = np.frombuffer(data, np.uint8, (width - 1) * n, 13)
    top = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[13 + len(low) :]), np.uint8)
    steps = np.zeros((n, 8), np.uint8)
    steps[:, :width] = np.concatenate([low, top]).reshape(width, n).T
    return np.cumsum(np.concatenate([np.frombuffer(data[5:13], np.uint64), steps.reshape(-1).view(np.uint64)]), dtype=np.uint64)


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts, compressed, in a byte each if they fit, else in four."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes())


def _unpack_counts(data: bytes, n: int) -> np.ndarray:
    import zstandard

    plain = zstandard.ZstdDecompressor().decompress(data)
    return np.frombuffer(plain, np.uint8 if len(plain) == n else np.uint32)


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([press.compress(t or b"") for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("doc_id"), z], ["block", "doc_id", "z"])


def _requests(table, order: int, parts: int):
    """A block's distinct n-grams, by part."""
    block = table.column("block")[0].as_py()
    grams, _, there = _grams(_texts(table), order)
    rows = []
    for k in range(order):
        distinct, counts = np.unique(grams[k][there[k]], return_counts=True)
        cuts = np.searchsorted(distinct, _bounds(parts))
        for part, (g, c) in enumerate(zip(np.split(distinct, cuts), np.split(counts, cuts))):
            if len(g):
                rows.append((k + 1, part, block, _pack(g), _pack_counts(c)))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["gram", "part", "block", "hashes", "counts"])


def _answers(table):
    """The counts over all blocks of each block's n-grams, in the block's order."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    hashes = [_unpack(x) for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([_unpack_counts(x, len(h)) for x, h in zip(table.column("counts").to_pylist(), hashes)])
    distinct, which = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(which, weights=counts, minlength=len(distinct)).astype(np.int64)[which]
    cuts = np.cumsum([len(h) for h in hashes])[:-1]
    out = pa.array([press.compress(t.tobytes()) for t in np.split(total, cuts)], pa.binary())
    return pa.table([table.column("gram"), table.column("part"), table.column("block"), out], ["gram", "part", "block", "totals"])


def _scores(docs, answers, order: int, all_words: int):
    """doc_id, n_words, log_score of a block's documents."""
    import zstandard

    plain = zstandard.ZstdDecompressor()
    grams, sizes, there = _grams(_texts(docs), order)
    n, doc = len(grams[0]), np.repeat(np.arange(len(sizes)), sizes)
    rows = answers.to_pylist()
    left = []
    for k in range(order):
        own = sorted((r for r in rows if r["gram"] == k + 1), key=lambda r: r["part"])
        total = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(plain.decompress(r["totals"]), np.int64) for r in own)])
        _, which = np.unique(grams[k][there[k]], return_inverse=True)
        pairs, back, count = np.unique(which * max(1, len(sizes)) + doc[there[k]], return_inverse=True, return_counts=True)
        c = np.zeros(n, np.int64)
        c[there[k]] = total[which] - count[back]
        left.append(c)
    words_left = (all_words - sizes)[doc]
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where(left[0] > 0, left[0] / np.maximum(words_left, 1), 1 / (words_left + 1.0))
        for k in range(1, order):
            context = np.concatenate([[0], left[k - 1][:-1]])
            score = np.where(there[k], np.where(left[k] > 0, left[k] / np.maximum(context, 1), BACKOFF * score), score)
    logs = np.log(score)
    parts = [float(logs[e - s : e].sum()) for s, e in zip(sizes, np.cumsum(sizes))]
    return pa.table([docs.column("doc_id"), pa.array(sizes), pa.array(parts, pa.float64())], ["doc_id", "n_words", "log_score"])


def score(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every document."""
    spark = docs.sparkSession
    ship(spark)
    chars, all_words = (x or 0 for x in docs.agg(F.sum(F.length("text")), F.sum(F.size(words(F.col("text"))))).first())
    blocks, parts = max(1, -(-chars // BLOCK_CHARS)), max(1, -(-chars // (6 * PART_WORDS)))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    kept = map_arrow(rows, _squeeze, "block int, doc_id long, z binary")

    def ask(table):  # applyInArrow takes a function of a table by its lack of hints
        return _requests(table, order, parts)

    asked = kept.groupBy("block").applyInArrow(ask, "gram int, part int, block int, hashes binary, counts binary")
    answered = asked.groupBy("gram", "part").applyInArrow(_answers, "gram int, part int, block int, totals binary")

    def judge(left, right):
        return _scores(left, right, order, all_words)

    scored = kept.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(judge, "doc_id long, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
