"""Top-k retrieval: exact inner products and BM25."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.shipping import ship

#: Vectors per packed block; bytes of packed queries, and of the rows found for them, that one task meets: so many are
#: broadcast, more are dealt to further tasks.
BLOCK = 1024
TASK_BYTES = 64 << 20
#: Terms, of all queries together, up to which they are broadcast.
QUERY_TERMS = 500_000


def normalized(v: Column) -> Column:
    """A vector over its length; zero vectors stay."""
    wide = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def packed(df: DataFrame, key: str, vector: str, name: str) -> DataFrame:
    """Blocks of at most BLOCK rows: their keys as ``name``_ids and their vectors as ``name``_data, packed."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                v = np.stack(part.column("v").to_numpy(zero_copy_only=False))
                sound = np.isfinite(v).all(axis=1)
                keys, v = part.column("key").to_numpy()[sound], v[sound]
                if len(keys):
                    yield pa.RecordBatch.from_pydict({f"{name}_ids": [keys.astype("<i8").tobytes()], f"{name}_data": [v.astype("<f8").tobytes()]}, blocks)

    ship(df.sparkSession)
    blocks = pa.schema([(f"{name}_ids", pa.binary()), (f"{name}_data", pa.binary())])
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, f"{name}_ids binary, {name}_data binary")


def _best(row, key, score, k: int):
    """The ``k`` entries of each row of largest score, ties by key."""
    import numpy as np

    order = np.lexsort((key, -score, row))
    row = row[order]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], key[order[first]], score[order[first]]


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, key, score: the ``k`` corpus rows of largest inner product per query, ties by key. Blocks of
    queries meet blocks of the corpus, and each task keeps the best it has seen of its queries. Queries up to TASK_BYTES
    are broadcast; more are dealt to parts of that size, and each part meets each partition of the corpus in a task of
    its own. Nothing is collected. Keys are integers; rows without key or vector, or whose vector holds a null or
    non-finite component, take no part; vectors are of one length."""
    import numpy as np

    wanted = queries.where(F.col(key).isNotNull() & (F.size(vector) > 0))
    n, width = wanted.agg(F.count("*"), F.coalesce(F.max(F.size(vector)), F.lit(1))).first()
    parts = -(-n * max(8 * width, 24 * k) // TASK_BYTES)
    asked = packed(queries if parts <= 1 else queries.repartition(parts), key, vector, "q")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {}
        for batch in batches:
            for q_ids, q, keys, v in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_data", "c_ids", "c_data"))):
                keys = np.frombuffer(keys, "<i8")
                score = np.frombuffer(q, "<f8").reshape(len(q_ids) // 8, -1) @ np.frombuffer(v, "<f8").reshape(len(keys), -1).T
                least = np.partition(score, -k, axis=1)[:, -k] if len(keys) > k else np.full(len(score), -np.inf)
                row, at = np.nonzero(score >= least[:, None])  # with all ties of the last
                new = row, keys[at], score[row, at]
                # a block of queries goes by its ids and vectors, which rows that repeat an id may tell apart
                mark = q_ids, hash(q)
                held[mark] = _best(*(map(np.concatenate, zip(held[mark], new)) if mark in held else new), k)
        for (q_ids, _), (row, keys, score) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(q_ids, "<i8")[row]), pa.array(keys), pa.array(score)], ["query_id", key, "score"])

    blocks = packed(corpus, key, vector, "c")
    both = blocks.crossJoin(F.broadcast(asked)) if parts <= 1 else blocks.crossJoin(asked)
    found = both.mapInArrow(run, f"query_id long, {key} long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def terms(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term and the text's number of terms, a row per occurrence."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return df.select(key, words.alias("w")).select(key, F.size("w").alias("length"), F.explode("w").alias("term"))


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, key: str, text: str, query_key: str, query_text: str, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query_key, rank, key, score by BM25. Up to QUERY_TERMS terms of queries are broadcast: of the corpus only their
    occurrences are kept, before they are counted, and those of a document stay together, so that its scores are summed
    and all but the best of a task left out without another shuffle. More terms meet postings by shuffled joins. Fewer
    hits than ``k`` are returned as they are."""
    asked = terms(queries, query_key, query_text).groupBy(query_key, "term").agg(F.count("*").alias("qtf"))
    few = asked.limit(QUERY_TERMS + 1).count() <= QUERY_TERMS
    sent = F.broadcast if few else lambda df: df
    lengths = corpus.select(F.regexp_count(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+")).alias("n"))
    stats = lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    found = terms(corpus, key, text).join(sent(asked.select("term").distinct()), "term", "left_semi")
    postings = found.groupBy(key, "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "mean")
    weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    scored = (postings.repartition(key) if few else postings).join(sent(idf), "term").withColumn("weight", weight).join(sent(asked), "term")
    total = scored.groupBy(query_key, key).agg(F.sum(F.col("weight") * F.col("qtf")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc(F.round("score", 9)), key))
    return total.withColumn("rank", rank).where(F.col("rank") <= k)


def results(ranked: DataFrame, query: str, docs: DataFrame, key: str, contents: str) -> DataFrame:
    """query, documents and scores as arrays in rank order."""
    joined = ranked.join(docs.select(key, contents), key)
    rows = joined.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", contents, "score"))).alias("x"))
    return rows.select(query, F.transform("x", lambda e: e[contents]).alias("documents"), F.transform("x", lambda e: e["score"]).alias("scores"))


def title_and_text(contents: Column) -> Column:
    """The first line as title, the rest as text."""
    return F.struct(F.substring_index(contents, "\n", 1).alias("title"), F.regexp_replace(contents, r"^[^\n]*\n?", "").alias("text"))
