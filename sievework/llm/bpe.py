"""Byte-pair encoding and decoding with a minimal acyclic transducer for frequent words.

The words that occur most often in all documents are counted by Spark; the driver merges each of them once and compiles
them into a minimal acyclic automaton over UTF-8 bytes in which equal suffixes share their states. An arc carries the
number of words that sort before the words it leads to, so that the outputs along a word's path add up to its rank, and
the rank is the place of its ids in an array. The automaton is one file of flat arrays; Spark's file server hands it to
the executors, whose workers map it into memory. Words it lacks are merged exactly, by rank, leftmost first. A worker
takes the distinct chunks between white space of a batch of texts, and looks up and merges all words new to it together.

The tokenizer is given as a ``tokenizers`` JSON file: a BPE model with an end-of-word suffix behind NFC, white space and
lower case normalisation, a split pattern and byte-level symbols. White space takes no part in its tokens. Tokens added
to the vocabulary are found in the raw text first.

Defined cases: a null or blank text has no ids and decodes to the empty string; a null doc_id and repeated rows pass
through row by row; a word of any length is merged in n log n steps; an empty table gives no rows; columns named ``ids``
or ``decoded`` in the input are replaced, others are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import tempfile
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import after_task, cut, map_arrow, take_room

#: Words compiled into the lexicon.
LEXICON_WORDS = 32_768
#: Steps per doubling at which the lexicon's least count may lie.
PER_DOUBLING = 64
#: Bytes of words and of chunks between white space that a worker remembers, until its task ends; what an entry takes
#: besides its characters and ids, and the longest that is kept.
CACHE, CHUNKS, ENTRY, LONG = 72 << 20, 96 << 20, 200, 64
#: Texts encoded together, the longest word in bytes that is merged beside others, and the rank of a pair that has none.
BATCH, SHORT, NO_RANK = 1024, 48, 1 << 62
#: The first code point that Unicode hasn't assigned; below it, letters are the same in all its versions.
FIRST_UNKNOWN = "\u0378"
#: Marks that end most words that aren't letters alone.
PUNCTUATION = set(".,;:!?")
#: White space of the pattern engine: what Unicode calls so.
UNICODE_SPACE = "\t-\r \x85\xa0  -     　"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 upwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, more = [], 256
    for b in range(256):
        out.append(chr(b) if b in shown else chr(more))
        more += b not in shown
    return out


class Merger:
    """The exact encoder of one pre-token, and the split of a text into pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = added
        self.added_split = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.tokens: list[bytes] = [b""] * (max(*vocab.values(), *added.values()) + 1)
        for token, i in {**vocab, **added}.items():
            self.tokens[i] = token.encode()
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.last = [vocab[s + suffix] for s in symbols]
        # the rank of a pair, and by rank what it becomes
        self.merges: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        # the same in order of pairs, with tables of those that bytes make within a word and at its end
        keys = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(keys)
        self.pairs = np.append(keys[order], NO_RANK)
        self.ranks = np.append(np.array(list(self.merges.values()), np.int64)[order], -1)
        self.made_ids = np.array(self.made, np.int64)
        self.of_bytes = np.array([self.inner, self.last], np.int64)
        self.byte_ranks = self._ranks(self.of_bytes[0][:, None], self.of_bytes[:, None, :])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{UNICODE_SPACE}")).findall
        self.path = path
        self.library = None

    def normalize(self, text: str) -> str:
        """NFC, white space to a space, lower case character by character (no final sigma)."""
        if text.isascii():
            return text.lower()
        text = unicodedata.normalize("NFC", text)
        return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)

    def word(self, piece: bytes) -> list[int]:
        """The ids of a pre-token, given as its UTF-8 bytes."""
        ids = [self.inner[b] for b in piece[:-1]]
        ids.append(self.last[piece[-1]])
        return self._short(ids) if len(ids) <= SHORT else self._long(ids)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids, shifted to leave 32 bits for a place; NO_RANK where they don't merge."""
        key = left << 32 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.ranks[at] << 32, NO_RANK)

    def words(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of pre-tokens of at most SHORT bytes each. Every round merges each word's pair of least rank,
        the leftmost of equal ones, as ``word`` does for one."""
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = np.array(list(map(len, pieces)))
        ends = np.cumsum(sizes)
        first, end, n = ends - sizes, ends, len(data)
        at_end = np.zeros(n, np.int8)
        at_end[ends - 1] = 1
        ids = self.of_bytes[at_end, data]
        # by place: the rank of the pair that begins there and the place itself; the tokens before and after
        best = np.full(n + 1, NO_RANK)
        best[: n - 1] = self.byte_ranks[at_end[1:], data[:-1], data[1:]]
        best[ends - 1] = NO_RANK
        np.add(best, np.arange(n + 1), out=best, where=best < NO_RANK)
        before, after = np.arange(-1, n), np.arange(1, n + 2)
        left = np.ones(n, bool)
        while True:
            least = np.minimum.reduceat(best, np.stack([first, end], 1).ravel())[::2]
            more = least < NO_RANK
            first, end, least = first[more], end[more], least[more]
            if not len(first):
                break
            i = least & 0xFFFFFFFF
            j = after[i]
            k = after[j]
            ids[i], left[j], best[j], after[i], before[k] = self.made_ids[least >> 32], False, NO_RANK, k, i
            right, back = k < end, i > first
            best[i] = NO_RANK
            begin = np.concatenate([i[right], before[i[back]]])
            rank = self._ranks(ids[begin], ids[np.concatenate([k[right], i[back]])])
            best[begin] = np.where(rank < NO_RANK, rank + begin, NO_RANK)
        packed = ids[left].astype("<u4").tobytes()
        stops = np.cumsum(np.add.reduceat(left, ends - sizes, dtype=np.int64)) * 4
        return [packed[a:b] for a, b in zip([0, *stops.tolist()], stops.tolist())]

    def _short(self, ids: list[int]) -> list[int]:
        get, none, made = self.merges.get, 1 << 60, self.made
        found = [get(p, none) for p in zip(ids, ids[1:])]
        while found and (best := min(found)) != none:
            i = found.index(best)
            ids[i : i + 2] = [made[best]]
            del found[i]
            if i:
                found[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = get((ids[i], ids[i + 1]), none)
        return ids

    def _long(self, ids: list[int]) -> list[int]:
        get, n = self.merges.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank, i, ids[i], ids[i + 1]) for i in range(n - 1) if (rank := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.made[rank], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (rank := get((ids[left], ids[right]))) is not None:
                    heapq.heappush(heap, (rank, left, ids[left], ids[right]))
        return [x for x in ids if x >= 0]

    def split(self, segment: str) -> list[str]:
        """The pre-tokens of a text without added tokens. Where Python's Unicode tables lack a character, the library,
        whose tables may be newer or older than the pattern engine's, splits the text."""
        if segment.isascii():
            return self.pieces(segment.lower())
        if max(segment) < FIRST_UNKNOWN or not any(unicodedata.category(c) == "Cn" for c in segment):
            return self.pieces(self.normalize(segment))
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        text = self.library.normalizer.normalize_str(segment)
        return [bytes(map(self.byte_of.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Pre-tokens with -1, and added tokens with their id."""
        for k, segment in enumerate(self.added_split.split(text) if self.added_split else [text]):
            if k % 2:
                yield segment, self.added[segment]
            else:
                for piece in self.split(segment):
                    yield piece, -1


class Lexicon:
    """Reader of a compiled lexicon, which it maps into memory; ``get`` gives a word's ids or None, ``places`` the ranks
    of many words at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at, arrays = 40, []
        for n, kind in zip(struct.unpack("<5q", self.file[:40]), ("<u4", "<u4", "<u4", "u1", "<u4")):
            arrays.append(np.frombuffer(self.file, kind, n, at))
            at += -(-arrays[-1].nbytes // 8) * 8
        # of each state the first arc, times two, plus one if it accepts; of each arc target, output, label; then the
        # number of words, where each word's ids begin, and the ids
        self.first, self.target, self.output, labels, self.ids = arrays
        # arcs stand in order of state and label
        state = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first >> 1))
        self.arcs = np.append(state << 8 | labels, NO_RANK)

    def places(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 where the lexicon lacks it."""
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.array(list(map(len, words)), np.int64)
        begin = np.cumsum(sizes) - sizes
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        live, b = np.arange(len(words)), 0
        while len(live := live[sizes[live] > b]):
            key = state[live] << 8 | data[begin[live] + b]
            arc = np.searchsorted(self.arcs, key)
            found = self.arcs[arc] == key
            state[live[~found]] = -1
            live, arc, b = live[found], arc[found], b + 1
            rank[live] += self.output[arc]
            state[live] = self.target[arc]
        return np.where((state >= 0) & (self.first[state] & 1 == 1), rank, -1)

    def at(self, place: int) -> np.ndarray:
        """The ids of the word of a rank."""
        ids, n = self.ids, int(self.ids[0])
        return ids[n + 2 + int(ids[1 + place]) : n + 2 + int(ids[2 + place])]

    def get(self, word: bytes) -> list[int] | None:
        place = int(self.places([word])[0])
        return None if place < 0 else self.at(place).tolist()


def compile_lexicon(words: dict[bytes, list[int]], path: str) -> int:
    """Write the minimal acyclic transducer of ``words`` to ``path``; returns its number of states. Words are added in
    order; a state is frozen when no later word can reach it, and equal frozen states are one (Daciuk and others)."""
    order = sorted(w for w in words if w)
    register: dict[tuple, int] = {}
    frozen: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    spine: list[list] = [[False, []]]  # accepts, arcs [label, target or None]

    def freeze(down_to: int) -> None:
        while len(spine) > down_to + 1:
            accepts, arcs = spine.pop()
            state = (accepts, tuple(map(tuple, arcs)))
            if state not in register:
                register[state] = len(frozen)
                frozen.append(state)
            spine[-1][1][-1][1] = register[state]

    before = b""
    for w in order:
        same = len(os.path.commonprefix([before, w]))
        freeze(same)
        for b in w[same:]:
            spine[-1][1].append([b, None])
            spine.append([False, []])
        spine[-1][0] = True
        before = w
    freeze(0)
    frozen.append((spine[0][0], tuple(map(tuple, spine[0][1]))))
    below = []
    for accepts, arcs in frozen:
        below.append(accepts + sum(below[t] for _, t in arcs))
    first, target, output, label = [], [], [], []
    for accepts, arcs in reversed(frozen):
        first.append(len(label) * 2 + accepts)
        n = int(accepts)
        for b, t in arcs:
            label.append(b)
            target.append(len(frozen) - 1 - t)
            output.append(n)
            n += below[t]
    first.append(len(label) * 2)
    ids = [words[w] for w in order]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
    table = np.concatenate([[len(order)], offsets, *ids]).astype("<u4")
    with open(path, "wb") as f:
        np.array([len(first), len(target), len(output), len(label), len(table)], "<i8").tofile(f)
        for array, kind in ((first, "<u4"), (target, "<u4"), (output, "<u4"), (label, "u1"), (table, "<u4")):
            data = np.array(array, kind).tobytes()
            f.write(data + b"\0" * (-len(data) % 8))
    return len(frozen)


def frequent_words(docs: DataFrame, n: int = LEXICON_WORDS) -> list[str]:
    """The most frequent runs of letters of all texts, in lower case: all whose count reaches a limit, the least one of
    PER_DOUBLING a doubling that at most ``n`` words reach. A histogram of counts tells the limit, so that the driver
    gets its few bins and those words, whatever the number of partitions."""
    found = docs.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counts = cut(found.groupBy("word").count().where(F.length("word").between(1, 64)))
    level = F.floor(F.log2("count") * PER_DOUBLING).cast("int")
    limit, taken = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        if taken + r["words"] > n:
            break
        limit, taken = r["level"], taken + r["words"]
    return [] if limit is None else [r["word"] for r in counts.where(level >= limit).select("word").collect()]


class Coder:
    """A worker's encoder: what it has met before, else the lexicon, else exact merges; with ``library`` the words are
    merged by the tokenizers library instead. ``room`` bounds the bytes of words and of chunks it remembers."""

    def __init__(self, tokenizer_path: str, lexicon_path: str | None = None, library: bool = False, room: tuple[int, int] = (CACHE, CHUNKS)):
        self.merger = Merger(tokenizer_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.tokens = pa.array(self.merger.tokens, pa.binary())
        self.room = room
        self.model = None
        if library:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.model = Tokenizer.from_file(tokenizer_path).model
            self.symbols = byte_symbols()
        self.forget()

    def forget(self) -> None:
        self._forget_words()
        self._forget_chunks()

    def _forget_words(self) -> None:
        # packed ids by pre-token, and by id those of added tokens
        self.words: dict[str | int, bytes] = {i: struct.pack("<I", i) for i in self.merger.added.values()}
        self.held_words = 0

    def _forget_chunks(self) -> None:
        # numbers of chunks; by number, where its ids begin in ``ids``, with an end
        self.chunks: dict[str, int] = {}
        self.begins, self.ids = np.zeros(1, np.int64), np.zeros(0, "<i4")

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The packed ids of each of some pre-tokens."""
        if self.model:
            out = []
            for piece in pieces:
                shown = piece if piece.isascii() and piece.isprintable() else "".join(map(self.symbols.__getitem__, piece.encode()))
                out.append([t.id for t in self.model.tokenize(shown)])
            return [struct.pack("<%dI" % len(ids), *ids) for ids in out]
        data = [p.encode() for p in pieces]
        places = self.lexicon.places(data).tolist() if self.lexicon else [-1] * len(data)
        short = iter(self.merger.words([w for w, at in zip(data, places) if at < 0 and len(w) <= SHORT]))
        return [
            self.lexicon.at(at).tobytes() if at >= 0 else next(short) if len(w) <= SHORT else np.array(self.merger.word(w), "<u4").tobytes()
            for w, at in zip(data, places)
        ]

    def parts(self, text: str) -> list[str | int]:
        """What stands between white space, as pre-tokens and ids of added tokens."""
        low = text.lower() if text.isascii() else self.merger.normalize(text) if max(text) < FIRST_UNKNOWN else ""
        if low.isalpha():
            return [low]
        if low[-1:] in PUNCTUATION and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        if "<" not in text:
            return self.merger.split(text)
        return [p if i < 0 else i for p, i in self.merger.parts(text)]

    def learn(self, chunks: list[str]) -> range:
        """Numbers of chunks that are new."""
        if self.held_words > self.room[0]:
            self._forget_words()
        parts, words = list(map(self.parts, chunks)), self.words
        new = [p for p in dict.fromkeys(chain.from_iterable(parts)) if p not in words]
        merged = self.merged(new)
        words.update(zip(new, merged))
        self.held_words += sum(map(len, new)) + sum(map(len, merged)) + ENTRY * len(new)
        packed = [words[ps[0]] if len(ps) == 1 else b"".join(map(words.__getitem__, ps)) for ps in parts]
        begin = len(self.begins) - 1
        numbers = range(begin, begin + len(chunks))
        self.chunks.update(zip(chunks, numbers))
        for kept, added in ((words, new), (self.chunks, chunks)):
            for key in [k for k in added if len(k) > LONG]:
                del kept[key]
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(packed), "<i4")])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)) // 4)])
        return numbers

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of binary texts one after the other, and where each text's begin, with an end. No token spans white
        space, so chunks stand alone."""
        if len(self.begins) * ENTRY + self.ids.nbytes > self.room[1]:
            self._forget_chunks()
        lists = pc.ascii_split_whitespace(texts.fill_null(b"").view(pa.string()))
        coded = lists.flatten().view(pa.binary()).dictionary_encode()
        # no chunk holds a space, so that they are read as one string
        n = len(coded.dictionary)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), coded.dictionary), b" ")[0].as_py()
        distinct = joined.decode().split(" ") if n else []
        number = np.fromiter(map(self.chunks.get, distinct, repeat(-1)), np.int64, n)
        if len(new := np.flatnonzero(number < 0)):
            number[new] = self.learn([distinct[i] for i in new.tolist()])
        number = number[coded.indices.to_numpy()]
        begins = self.begins[number]
        counts = self.begins[number + 1] - begins
        ends = np.concatenate([[0], np.cumsum(counts)])
        ids = self.ids[np.repeat(begins - ends[:-1], counts) + np.arange(ends[-1])]
        return ids, ends[lists.offsets.to_numpy()]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as packed 32-bit integers."""
        ids, ends = self.encode_array(pa.array(texts, pa.binary()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def decode(self, lists: pa.ListArray) -> pa.Array:
        """Tokens of each list joined by a space, as a tokenizer without a decoder does."""
        tokens = pa.ListArray.from_arrays(lists.offsets, self.tokens.take(lists.values))
        return pc.binary_join(tokens, b" ").cast(pa.string())


_coders: dict[tuple[str, str | None], Coder] = {}
_sent: set[tuple[str, str]] = set()


def coder(tokenizer_path: str, lexicon_name: str | None) -> Coder:
    key = (tokenizer_path, lexicon_name)
    take_room("bpe", _coders.clear)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(tokenizer_path, SparkFiles.get(lexicon_name) if lexicon_name else None)
    after_task("bpe", _coders[key].forget)
    return _coders[key]


def ship_lexicon(docs: DataFrame, tokenizer_path: str, n: int = LEXICON_WORDS) -> str:
    """Compile the lexicon of ``docs`` and hand it to the executors; returns its name there."""
    merger = Merger(tokenizer_path)
    words = {}
    for w in frequent_words(docs, n):
        if (parts := list(merger.parts(w))) == [(w, -1)]:
            words[w.encode()] = merger.word(w.encode())
    folder = tempfile.mkdtemp(prefix="sievework-")
    compile_lexicon(words, f"{folder}/lexicon")
    with open(f"{folder}/lexicon", "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:24]}.bin"
    sc = docs.sparkSession.sparkContext
    if (sc.applicationId, name) not in _sent:  # a name tells the contents, and is sent once
        os.rename(f"{folder}/lexicon", f"{folder}/{name}")
        sc.addFile(f"{folder}/{name}")
        _sent.add((sc.applicationId, name))
    return name


def encode_decode(docs: DataFrame, tokenizer_path: str, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """doc_id, ``ids`` (array of int) and ``decoded`` (string) of every whole text."""
    lexicon = ship_lexicon(docs, tokenizer_path, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer_path, lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH):
                batch = whole.slice(at, BATCH)
                ids, ends = code.encode_array(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, code.decode(lists)], ["doc_id", "ids", "decoded"])

    schema = docs.select("doc_id").withColumns({"ids": F.array().cast("array<int>"), "decoded": F.lit("")}).schema
    return map_arrow(docs.select("doc_id", F.col("text").cast("binary").alias("text")), run, schema)
