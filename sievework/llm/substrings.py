"""Removal of repeated passages with compressed FM-indexes.

A window is WINDOW consecutive words of a document; a word goes if a window over it has the same words as a window that
starts earlier. Holding every document against every shard's index would take the square of the corpus, so hashes route
windows to the one shard where equal ones meet: by minimizers, the least hash among a window's runs of RUN words. Windows
in a row with one minimizer at one place form a segment, no two windows of which are equal.

1. Scan: every task hashes words, cuts segments and emits (minimizer, digest, place).
2. Segments sorted by minimizer, digest and place: a minimizer that occurs once routes nothing and is dropped. Segments
   with the same minimizer and digest, 128 bits together, have the same contents; the first is their head, the others
   are its copies.
3. Minimizers with more than HOT heads are routed anew by single windows: each is a segment whose minimizer and digest are
   hashes of its words, so that a hot window has one head as well.
4. The words of heads are read again and dealt by minimizer to shards of about SHARD_SEGMENTS. A shard builds an FM-index
   over them and drops the suffix array. Heads are streamed against it, each once for all of its copies: backward search
   gives their windows' matching statistics, up to WINDOW, and windows with the same interval are occurrences of the same
   words, all but the first of them repeats. Heads with copies are searched as a whole too; where the index holds all
   their words, their copies are repeats.
5. Copies of confirmed heads and the repeats of shards are gathered per document and taken out of the text.

Defined cases: a null text has no words; fewer words than a window lose nothing; a null doc_id counts as the last; every
distinct pair of doc_id and text is a document, told apart by ``key`` and ``twin``, a hash of the text, and ordered by
both (equal rows change nothing and get the same result); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.fm_index import FMIndex
from sievework.llm.shared import cut, map_arrow
from sievework.llm.shingles import mixed, rolling, word_hashes
from sievework.shipping import ship

WINDOW, RUN = 20, 5
#: Words per buffer of the scan; heads per shard; heads from which a minimizer's segments are cut into windows.
BUFFER_WORDS, SHARD_SEGMENTS, HOT = 4_000_000, 40_000, 20_000
LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15
#: Most words of a segment: windows that share a run, and what the last of them adds.
LONGEST = 2 * WINDOW - RUN
PLACE = "key long, twin long, start int, size int"
ROUTED = "mini long, digest long, " + PLACE
#: With 1 for the first segment of a digest in its task's buffer and 2 for its copies there.
SCANNED = ROUTED + ", again tinyint"


def _segments(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of words ``h`` of documents that end at ``ends``: minimizer, digest, first window and windows of each segment."""
    n = len(h) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    least, width = rolling(h, RUN), 1
    place = np.arange(len(least), dtype=np.int32)  # of the leftmost run with the least hash

    def halve(by: int) -> None:
        nonlocal least, place
        left = least[: len(least) - by] <= least[by:]
        place = np.where(left, place[: len(place) - by], place[by:])
        least = np.where(left, least[: len(least) - by], least[by:])

    while width * 2 <= WINDOW - RUN + 1:
        halve(width)
        width *= 2
    if width < WINDOW - RUN + 1:
        halve(WINDOW - RUN + 1 - width)
    valid = np.ones(n, bool)
    for k in range(1, WINDOW):  # windows that would run over a document's end
        out = ends - k
        valid[out[(out >= 0) & (out < n)]] = False
    starts = valid.copy()
    starts[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    first = np.flatnonzero(starts)
    stops = np.flatnonzero(valid & ~np.concatenate([valid[1:] & ~starts[1:], [False]])) + 1
    base = np.full(len(h), _BASE, np.uint64)
    base[0] = 1
    power = np.multiply.accumulate(base)
    inverse = np.full(len(h), pow(_BASE, -1, 1 << 64), np.uint64)
    inverse[0] = 1
    inverse = np.multiply.accumulate(inverse)
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(h) * power)])
    size = stops - first
    digest = mixed((total[stops + WINDOW - 1] - total[first]) * inverse[first] + size.astype(np.uint64))
    return least[first], digest, first, size


def _routed(mini, digest, key, twin, start, size, again=None) -> pa.RecordBatch:
    """Rows of ROUTED; with ``again``, of SCANNED."""
    columns = [pa.array(mini), pa.array(digest), pa.array(key), pa.array(twin), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))]
    names = ["mini", "digest", "key", "twin", "start", "size"]
    return pa.RecordBatch.from_arrays(columns, names) if again is None else pa.RecordBatch.from_arrays([*columns, pa.array(again)], [*names, "again"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, text) to SCANNED."""
    keys, twins, hashes, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        h = np.concatenate(hashes)
        ends = np.cumsum([len(x) for x in hashes])
        mini, digest, first, size = _segments(h, ends)
        doc = np.searchsorted(ends, first, side="right")
        start = first - np.concatenate([[0], ends[:-1]])[doc]
        mini, digest, key, twin = mini.view(np.int64), digest.view(np.int64), np.array(keys, np.int64)[doc], np.array(twins, np.int64)[doc]
        order = np.lexsort((start, twin, key, digest, mini))
        fresh = np.ones(len(order), bool)  # equal rows of the table are one place
        fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (mini, digest, key, twin, start)], axis=0)
        order = order[fresh]
        same = np.zeros(len(order), bool)
        same[1:] = (mini[order[1:]] == mini[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
        again = same.astype(np.int8) * 2
        again[:-1] = np.where(same[1:] & ~same[:-1], 1, again[:-1])
        return _routed(mini[order], digest[order], key[order], twin[order], start[order], size[order], again)

    for batch in batches:
        for key, twin, text in zip(*(batch.column(c).to_pylist() for c in ("key", "twin", "text"))):
            words = (text or b"").split()
            if len(words) >= WINDOW:
                keys.append(key)
                twins.append(twin)
                hashes.append(word_hashes(words))
                held += len(words)
            if held >= BUFFER_WORDS:
                yield flush()
                keys, twins, hashes, held = [], [], [], 0
    if hashes:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of SCANNED, copies first and the others in the order of ROUTED: copies, and those whose minimizer occurs at
    several places, with ``head`` for the first of a digest and ``copied`` for heads with copies. What is held from one
    batch to the next is two rows."""
    names = ["mini", "digest", "key", "twin", "start", "size"]
    held = np.zeros((0, 7), np.int64)  # the last row, not yet sent, behind the one before it

    def told(rows: np.ndarray, first: int, last: int) -> pa.RecordBatch:
        """Of rows ``first`` to ``last``, whose neighbours are there as far as they exist, those that meet others."""
        near = rows[1:, 0] == rows[:-1, 0]
        same = near & (rows[1:, 1] == rows[:-1, 1])
        back = lambda x: np.concatenate([[False], x])
        ahead = lambda x: np.concatenate([x, [False]])
        ahead_in_buffer = rows[:, 6] == 1
        meets, head, copied = back(near) | ahead(near) | ahead_in_buffer, ~back(same), ahead(same) | ahead_in_buffer
        at = first + np.flatnonzero(meets[first:last])
        routed = _routed(*(rows[at, i] for i in range(6)))
        return pa.RecordBatch.from_arrays([*routed.columns, pa.array(head[at]), pa.array((head & copied)[at])], [*names, "head", "copied"])

    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in (*names, "again")], axis=1)
        copies = rows[rows[:, 6] == 2]
        if len(copies):
            no = pa.array(np.zeros(len(copies), bool))
            yield pa.RecordBatch.from_arrays([*_routed(*(copies[:, i] for i in range(6))).columns, no, no], [*names, "head", "copied"])
        rows = np.concatenate([held, rows[rows[:, 6] != 2]])
        if len(rows) == len(held):
            continue
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :5] != rows[:-1, :5]).any(axis=1)  # equal rows of the table are one place
        rows = rows[new]
        yield told(rows, len(held) - 1 if len(held) else 0, len(rows) - 1)
        held = rows[-2:]
    if len(held):
        yield told(held, len(held) - 1, len(held))


def _read_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, text, segments) to (mini, digest, copied, key, twin, start, words)."""
    names = ["mini", "digest", "copied", "key", "twin", "start", "words"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    for batch in batches:
        rows = []
        for key, twin, text, segments in zip(*(batch.column(c).to_pylist() for c in ("key", "twin", "text", "segments"))):
            words = text.split()
            rows += [(s["mini"], s["digest"], s["copied"], key, twin, s["start"], b" ".join(words[s["start"] : s["start"] + s["size"] + WINDOW - 1])) for s in segments]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, twin, text, segments) to SCANNED, a row per window of the segments, by hashes of its words."""
    import xxhash

    for batch in batches:
        mini, digest, keys, twins, starts = [], [], [], [], []
        for key, twin, text, segments in zip(*(batch.column(c).to_pylist() for c in ("key", "twin", "text", "segments"))):
            words = text.split()
            for s in segments:
                for i in range(s["start"], s["start"] + s["size"]):
                    whole = xxhash.xxh3_128_intdigest(b" ".join(words[i : i + WINDOW]))
                    mini.append((whole >> 64) - (1 << 63))
                    digest.append((whole & (1 << 64) - 1) - (1 << 63))
                    keys.append(key)
                    twins.append(twin)
                    starts.append(i)
        longs = [np.array(x, np.int64) for x in (mini, digest, keys, twins, starts)]
        yield _routed(*longs, np.ones(len(starts), np.int32), np.zeros(len(starts), np.int8))


def _search_shard(table):  # applyInArrow takes a function of a table by its lack of hints
    """Of a shard's heads the repeats among them, as PLACE, and the heads with copies that the index holds, as mini and
    digest."""
    key, twin, start = (table.column(c).to_numpy() for c in ("key", "twin", "start"))
    order = np.lexsort((start, twin, key))
    fresh = np.ones(len(order), bool)  # rows that repeat a document bring its heads again
    fresh[1:] = np.any([x[order[1:]] != x[order[:-1]] for x in (key, twin, start)], axis=0)
    order = order[fresh]
    key, twin, start = key[order], twin[order], start[order].astype(np.int64)
    mini, digest, copied = (table.column(c).to_numpy(zero_copy_only=False)[order] for c in ("mini", "digest", "copied"))
    texts = table.column("words").to_pylist()
    texts = [texts[i].split() for i in order]
    ids: dict[bytes, int] = {}
    for words in texts:
        for w in words:
            ids.setdefault(w, len(ids) + 1)
    sizes = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    stream = np.zeros(int(sizes.sum() + len(sizes)), np.int32)  # segments, each followed by a 0
    inside = np.ones(len(stream), bool)
    inside[begin + sizes] = False
    stream[inside] = np.fromiter((ids[w] for words in texts for w in words), np.int32, int(sizes.sum()))
    del texts
    index = FMIndex(stream, len(ids) + 1, LONGEST)
    counts = sizes - WINDOW + 1
    seg = np.repeat(np.arange(len(sizes)), counts)
    windows = begin[seg] + np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts)
    matched, low, _ = index.search(stream, windows, np.full(len(windows), WINDOW), 2)
    shared = np.flatnonzero(matched == WINDOW)  # windows that the index holds twice or more, in the order of places
    hit = np.zeros(len(windows), bool)
    hit[shared] = True
    hit[shared[np.unique(low[shared], return_index=True)[1]]] = False
    first, last = hit.copy(), hit.copy()
    first[1:] &= ~hit[:-1] | (seg[1:] != seg[:-1])
    last[:-1] &= ~hit[1:] | (seg[1:] != seg[:-1])
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    s = seg[a]
    with_copies = np.flatnonzero(copied)
    matched, _, _ = index.search(stream, begin[with_copies], sizes[with_copies], 1)
    held = with_copies[matched == sizes[with_copies]]
    none = lambda n, kind: pa.nulls(n, kind)
    places = [key[s], twin[s], (start[s] + windows[a] - begin[s]).astype(np.int32), (b - a + 1).astype(np.int32)]
    out = [pa.chunked_array([none(len(s), pa.int64()), pa.array(x[held])]) for x in (mini, digest)]
    out += [pa.chunked_array([pa.array(x), none(len(held), pa.int64() if x.dtype == np.int64 else pa.int32())]) for x in places]
    return pa.table(out, ["mini", "digest", "key", "twin", "start", "size"])


def _take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, repeats) to (doc_id, n_words, n_removed, kept)."""
    for batch in batches:
        total, gone, kept = [], [], []
        for text, repeats in zip(batch.column("text").to_pylist(), batch.column("repeats").to_pylist()):
            words = (text or b"").split()
            total.append(len(words))
            if repeats:
                steps = np.zeros(len(words) + 1, np.int32)
                at = np.array([(r["start"], r["start"] + r["size"] + WINDOW - 1) for r in repeats])
                np.add.at(steps, at[:, 0], 1)
                np.add.at(steps, at[:, 1], -1)
                stay = np.cumsum(steps[:-1]) == 0
                words = [w for w, s in zip(words, stay.tolist()) if s]
            gone.append(total[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        z = pa.array([press.compress(t or b"") for t in batch.column("text").to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), batch.column("twin"), z], ["doc_id", "key", "twin", "z"])


def _unsqueezed(run, column: str):
    """``run`` over batches whose ``z`` is turned into ``text``, a few rows at a time."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        plain = zstandard.ZstdDecompressor()

        def opened() -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 128):
                    batch = whole.slice(at, 128)
                    text = pa.array([plain.decompress(z) for z in batch.column("z").to_pylist()], pa.binary())
                    kept = [c for c in batch.schema.names if c != "z"]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), text], [*kept, "text"])

        return run(opened())

    return wrapped


def _met(routed: DataFrame) -> DataFrame:
    """The rows of ``routed`` (SCANNED) that ``_meet`` leaves. Copies within a buffer are dealt by document, so that a
    hot minimizer is a row per buffer."""
    copy = F.col("again") == 2
    dealt = routed.repartition(F.when(copy, F.xxhash64("key", "twin")).otherwise(F.col("mini")))
    dealt = dealt.sortWithinPartitions(F.when(copy, 0).otherwise(1), "mini", "digest", "key", "twin", "start")
    return cut(map_arrow(dealt, _meet, ROUTED + ", head boolean, copied boolean"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and ``kept``, the words that stay, of every document."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("key"), F.xxhash64("text", F.col("doc_id").isNull()).alias("twin"), F.col("text").cast("binary").alias("text"))
    squeezed = map_arrow(rows, _squeeze, "doc_id long, key long, twin long, z binary")

    def read(segments: DataFrame, run, schema: str) -> DataFrame:
        """``run`` over the texts that have some of ``segments``."""
        wanted = segments.groupBy("key", "twin").agg(F.collect_list(F.struct("mini", "digest", "copied", "start", "size")).alias("segments"))
        texts = squeezed.select("key", "twin", "z").join(wanted, ["key", "twin"])
        return map_arrow(texts, _unsqueezed(run, "z"), schema)

    met = _met(map_arrow(rows.select("key", "twin", "text"), _scan, SCANNED))
    sizes = met.where("head").groupBy("mini").agg(F.count("*").alias("n"))
    hot = cut(sizes.where(F.col("n") > HOT).select("mini"))
    n_hot = hot.count()
    if n_hot:
        hot = F.broadcast(hot) if n_hot <= 100_000 else hot
        again = _met(read(met.join(hot, "mini", "left_semi"), _windows, SCANNED))
        met = met.join(hot, "mini", "left_anti").select(again.columns).unionByName(again)
    heads, copies = met.where("head"), met.where("NOT head")
    words = read(heads, _read_words, "mini long, digest long, copied boolean, key long, twin long, start int, words binary")
    shards = max(1, -(-heads.count() // SHARD_SEGMENTS))
    ship(spark)
    found = cut(words.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).groupBy("shard").applyInArrow(_search_shard, ROUTED))
    confirmed = found.where("key IS NULL").select("mini", "digest").distinct()
    repeats = found.where("key IS NOT NULL").select("key", "twin", "start", "size")
    repeats = repeats.unionByName(copies.join(confirmed, ["mini", "digest"]).select("key", "twin", "start", "size"))
    gathered = repeats.groupBy("key", "twin").agg(F.collect_list(F.struct("start", "size")).alias("repeats"))
    joined = squeezed.join(gathered, ["key", "twin"], "left").select("doc_id", "z", "repeats")
    return map_arrow(joined, _unsqueezed(_take_out, "z"), "doc_id long, n_words long, n_removed long, kept string")
