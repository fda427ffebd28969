"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are cut into SUB-dimensional pieces with 16 centres each. Codes and centres minimise an anisotropic loss: the part
of the residual that is parallel to the vector, which shifts inner products with its near queries, weighs more than the
orthogonal part. Four-bit codes, two to a byte, are scanned with tables of partial inner products; entries that may
belong to a query's best are reranked by exact inner products in double precision.

Which these are depends on the query and on the entry: a query's errors, in units of the entries' residuals, are
measured on the sample, over all of it and over its CANDIDATES nearest, and an entry is reranked where its approximate
product and DEVIATIONS such errors times its own residual reach the least of the best known so far. Those of the sample
are the first of them. So tight clusters, which codes can't tell apart, and vectors of very unlike norms are reranked
whole, while few are where codes tell much.

Equal vectors are one entry with its least ids, as many as a result can hold, so that a hot vector is neither a hot
group nor crowds out others. Codebooks are fitted on SAMPLE entries of least hash; every entry is encoded. A task holds
codes and vectors of one group of entries, scans them for one block of queries of its part after the other and passes
on little more than the k best of each query, whatever the number of entries.

Defined cases: vectors that are null, zero, of another length than most, or hold a null or non-finite component take no
part; of rows that repeat a vec_id with different vectors the least vector counts; ties go to the smaller vec_id; with
fewer candidates than asked for all are returned; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.shared import cut, map_arrow, partitions

SUB, CENTRES = 2, 16
#: Vectors the codebooks are fitted on, rounds of fitting, and the share of a query's norm that counts as near.
SAMPLE, ROUNDS, NEAR = 4096, 8, 0.2
#: Queries and entries that are scanned at once; entries of a group at least, and bytes of its vectors, which a task
#: holds, at most. Groups and parts of the queries make as many tasks as there are shuffle partitions, within these bounds.
QUERY_BLOCK, ENTRY_BLOCK, GROUP_LEAST, GROUP_BYTES = 256, 2048, 1024, 64 << 20
#: Entries of the sample, nearest to a query, on which its error is measured; errors that an entry may lie off; entries
#: beyond those asked for that a scan passes on, since sums in another order may differ in the last bits.
CANDIDATES, DEVIATIONS, SPARE = 256, 3.0, 3
PACKED = "slot int, kind int, ids binary, data binary, vectors binary"


class Codebook:
    """Centres of all pieces, (pieces, CENTRES, SUB), and the weight of the parallel residual."""

    def __init__(self, sample: np.ndarray):
        n, d = sample.shape
        self.pieces = -(-d // SUB)
        self.extra = max(0.0, (d - 1) * NEAR**2 / (1 - NEAR**2) - 1)
        x = self.cut(sample)
        unit = self.cut(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        random = np.random.default_rng(7)
        self.centres = np.empty((self.pieces, CENTRES, SUB))
        for m in range(self.pieces):
            centres = x[random.permutation(n)[:CENTRES], m]
            centres = np.resize(centres, (CENTRES, SUB)) if len(centres) < CENTRES else centres.copy()
            for _ in range(ROUNDS):
                near = ((x[:, m, None] - centres) ** 2).sum(-1).argmin(1)
                for k in np.unique(near):
                    centres[k] = x[near == k, m].mean(0)
            self.centres[m] = centres
        for _ in range(ROUNDS):
            codes = self.encode(sample)
            self._refit(x, unit, codes)

    def cut(self, v: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(v), self.pieces * SUB))
        wide[:, : v.shape[1]] = v
        return wide.reshape(len(v), self.pieces, SUB)

    def _refit(self, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        rows = np.arange(self.pieces)
        parallel = ((x - self.centres[rows, codes]) * unit).sum(-1)
        whole = parallel.sum(1)
        for m in range(self.pieces):
            u, rest = unit[:, m], whole - parallel[:, m]
            a = np.eye(SUB) + self.extra * u[:, :, None] * u[:, None, :]
            b = x[:, m] + self.extra * u * ((x[:, m] * u).sum(1) + rest)[:, None]
            for k in np.unique(codes[:, m]):
                mine = codes[:, m] == k
                self.centres[m, k] = np.linalg.solve(a[mine].sum(0), b[mine].sum(0))
            new = ((x[:, m] - self.centres[m, codes[:, m]]) * u).sum(1)
            whole += new - parallel[:, m]
            parallel[:, m] = new

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the anisotropic loss, from the nearest centres."""
        x, unit = self.cut(v), self.cut(v / np.linalg.norm(v, axis=1, keepdims=True))
        residual = x[:, :, None] - self.centres[None]
        apart = (residual**2).sum(-1)
        along = np.einsum("nmkd,nmd->nmk", residual, unit)
        codes, rows = apart.argmin(-1), np.arange(len(v))
        whole = np.take_along_axis(along, codes[:, :, None], 2)[:, :, 0].sum(1)
        for _ in range(2):
            for m in range(self.pieces):
                rest = whole - along[rows, m, codes[:, m]]
                codes[:, m] = (apart[:, m] + self.extra * (rest[:, None] + along[:, m]) ** 2).argmin(1)
                whole = rest + along[rows, m, codes[:, m]]
        return codes

    def packed(self, codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes to a byte."""
        if self.pieces % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), codes.dtype)], axis=1)
        return (codes[:, ::2] * CENTRES + codes[:, 1::2]).astype(np.uint8)

    def residuals(self, v: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Norms of what codes leave of their vectors."""
        codes = np.stack([packed // CENTRES, packed % CENTRES], axis=2).reshape(len(packed), -1)[:, : self.pieces]
        out = np.zeros(len(v))
        for begin in range(0, len(v), 4096):
            part = slice(begin, begin + 4096)
            out[part] = np.sqrt(((self.cut(v[part]) - self.centres[np.arange(self.pieces), codes[part]]) ** 2).sum((1, 2)))
        return out

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Per byte of a code and its value the partial inner products of all queries: (bytes, 256, queries)."""
        part = np.einsum("qmd,mkd->mkq", self.cut(queries), self.centres).astype(np.float32)
        if self.pieces % 2:
            part = np.concatenate([part, np.zeros_like(part[:1])])
        return (part[::2, :, None] + part[1::2, None]).reshape(len(part) // 2, CENTRES * CENTRES, len(queries))


def usable(vectors: DataFrame, id_column: str, column: str) -> DataFrame:
    """id and v (array of double, as given) of the vectors that take part."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_column).isNotNull() & v.isNotNull()).where(~odd & F.exists(v, lambda x: x != 0))
    rows = rows.groupBy(F.col(id_column).alias("id")).agg(F.min(v).cast("array<double>").alias("v"))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(sizes.select("n")), F.size("v") == F.col("n")).drop("n")


def packed_rows(rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """slot, kind, ids, data and vectors as PACKED."""
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    plain = [(int(slot), kind, *(np.ascontiguousarray(x).tobytes() for x in rest)) for slot, kind, *rest in rows]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in plain], kind) for i, kind in enumerate(kinds)], ["slot", "kind", "ids", "data", "vectors"])


def scanned(tables: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Approximate products, (entries, queries)."""
    scores = tables[0][code[:, 0]]
    part = np.empty_like(scores)
    for j in range(1, code.shape[1]):
        scores += np.take(tables[j], code[:, j], axis=0, out=part, mode="clip")
    return scores


def expected(book: Codebook, sample: np.ndarray, queries: np.ndarray, most: int, near: int) -> np.ndarray:
    """Per query the ``most``-th best product in the sample and the error to reckon with, in units of a residual."""
    code = book.packed(book.encode(sample))
    exact, rest = sample @ queries.T, book.residuals(sample, code)
    off = np.divide(exact - scanned(book.tables(queries), code), rest[:, None], out=np.zeros_like(exact), where=rest[:, None] > 0)
    floor, errors = np.full(len(queries), -np.inf), [np.linalg.norm(queries, axis=1) / math.sqrt(queries.shape[1])]
    if len(sample) >= most:
        floor = np.partition(exact, len(sample) - most, axis=0)[len(sample) - most]
    if len(sample) > near:
        errors.append(np.sqrt((off**2).mean(0)))
        off = np.take_along_axis(off, np.argpartition(exact, len(sample) - near, axis=0)[-near:], 0)
    errors.append(np.sqrt((off**2).mean(0)))
    return np.stack([floor, np.maximum.reduce(errors)], axis=1)


class Group:
    """The entries of a task, those of small residuals first, so that a block's are alike."""

    def __init__(self, book: Codebook, held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        entries, codes, vectors = (np.concatenate(x) for x in zip(*held))
        rest = book.residuals(vectors, codes)
        order = np.argsort(rest, kind="stable")
        self.book, self.entries, self.codes, self.vectors, self.rest = book, entries[order], codes[order], vectors[order], rest[order]
        self.norm = np.linalg.norm(vectors, axis=1).max()

    def best(self, ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, error: np.ndarray, most: int) -> pa.RecordBatch:
        """The ``most`` entries of largest product for each query, among those that may be."""
        tables, floor = self.book.tables(queries), floor.copy()
        slack = 1e-5 * self.norm * np.linalg.norm(queries, axis=1)
        row, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for begin in range(0, len(self.entries), ENTRY_BLOCK):
            end = min(begin + ENTRY_BLOCK, len(self.entries))
            least = floor - DEVIATIONS * error * self.rest[end - 1] - slack
            e, q = np.nonzero(~(scanned(tables, self.codes[begin:end]) < least.astype(np.float32)))
            if 20 * len(e) > (end - begin) * len(queries):
                exact = (self.vectors[begin:end] @ queries.T)[e, q]
            else:
                exact = np.einsum("ij,ij->i", self.vectors[begin + e], queries[q])
            good = exact >= floor[q]
            row, at, score = np.concatenate([row, q[good]]), np.concatenate([at, begin + e[good]]), np.concatenate([score, exact[good]])
            order = np.lexsort((self.entries[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            floor[row[place == most - 1]] = score[place == most - 1]
            row, at, score = (x[place < most] for x in (row, at, score))
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(self.entries[at]), pa.array(score)], ["query_id", "entry", "about"])


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", column: str = "embedding", candidates: int = CANDIDATES) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector for which ``is_query`` (on ``id``) holds the ``k`` others of
    largest inner product among those that the scan finds. ``candidates`` of the sample set a query's error."""
    rows = cut(usable(vectors, id_column, column))
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    least = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    entries = cut(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("entry", F.col("ids")[0]))
    n = entries.count()
    most = k + 1 + SPARE
    queries = rows.where(is_query).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    n_queries = queries.count()
    if n == 0 or n_queries == 0:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    share = min(1.0, 2 * SAMPLE / n)
    hashed = entries.select("v", "entry", F.xxhash64("entry").alias("h"))
    few = hashed.where(F.shiftrightunsigned("h", 24) < int(share * (1 << 40)))
    sample = np.array([r["v"] for r in few.orderBy("h", "entry").limit(SAMPLE).collect()] or [r["v"] for r in hashed.orderBy("h").limit(1).collect()])
    book = Codebook(sample)

    tasks = partitions(entries.sparkSession)
    parts = max(1, math.isqrt(tasks * n_queries // n))
    groups = max(min(-(-n // GROUP_LEAST), -(-tasks // parts)), -(-n * 8 * sample.shape[1] // GROUP_BYTES))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ENTRY_BLOCK):
                part = batch.slice(at, ENTRY_BLOCK)
                v = np.stack(part.column("v").to_numpy(zero_copy_only=False))
                code = book.packed(book.encode(v))
                entry, group = part.column("entry").to_numpy(), part.column("group").to_numpy()
                yield packed_rows([(g, 0, entry[group == g], code[group == g], v[group == g]) for g in np.unique(group)])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERY_BLOCK):
                chunk = batch.slice(at, QUERY_BLOCK)
                ids, q = chunk.column("query_id").to_numpy(), np.stack(chunk.column("q").to_numpy(zero_copy_only=False))
                yield packed_rows([(at // QUERY_BLOCK % parts, 1, ids, expected(book, sample, q, most, candidates), q)])

    group = F.pmod(F.xxhash64("entry"), F.lit(groups)).cast("int").alias("group")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    codes = map_arrow(entries.select("entry", "v", group), encode, PACKED).withColumn("other", each(parts)).withColumn("slot", F.col("slot") * parts + F.col("other"))
    asked = map_arrow(queries, ask, PACKED).withColumn("other", each(groups)).withColumn("slot", F.col("other") * parts + F.col("slot"))
    both = codes.unionByName(asked).drop("other").repartitionById(groups * parts, F.col("slot")).sortWithinPartitions("slot", "kind")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group, open_slot = [], None, None
        for batch in batches:
            for slot, kind, ids, data, vectors in zip(*(batch.column(c).to_pylist() for c in ("slot", "kind", "ids", "data", "vectors"))):
                if slot != open_slot:
                    held, group, open_slot = [], None, slot
                ids = np.frombuffer(ids, np.int64)
                vectors = np.frombuffer(vectors, np.float64).reshape(len(ids), -1)
                if kind == 0:
                    held.append((ids, np.frombuffer(data, np.uint8).reshape(len(ids), -1), vectors))
                    continue
                if held:
                    group, held = Group(book, held), []
                if group is not None:
                    floor, error = np.frombuffer(data, np.float64).reshape(len(ids), 2).T
                    yield group.best(ids, vectors, floor, error, most)

    found = map_arrow(both, scan, "query_id long, entry long, about double")
    order = Window.partitionBy("query_id").orderBy(F.desc("about"), "entry")
    short = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "entry")
    exact = short.join(entries, "entry").join(queries, "query_id").select("query_id", "entry", "ids", inner_product(F.col("q"), F.col("v")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "entry")
    few = exact.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k + 1)
    out = few.select("query_id", F.explode("ids").alias("vec_id"), "score").where("query_id <> vec_id")
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
