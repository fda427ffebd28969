"""Table verbs over rows with a position, ``row_id``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType


def range_bounds(df: DataFrame, order: str, ranges: int) -> DataFrame:
    """One row with an array ``bounds_``, sorted, that cuts ``df`` into some ``ranges`` of about as many rows. They come
    from random rows and are fixed once, so that whatever reads them cuts alike."""
    few = df.select(F.col(order).alias("at_")).where(F.col("at_").isNotNull()).orderBy(F.rand()).limit(20 * ranges)
    placed = few.select("at_", F.ntile(ranges).over(Window.orderBy("at_")).alias("tile_")).groupBy("tile_").agg(F.min("at_").alias("at_"))
    kind = ArrayType(df.schema[order].dataType)
    bounds = df.sparkSession.createDataFrame([([r["at_"] for r in placed.collect()],)], StructType([StructField("bounds_", kind)]))
    return bounds.select(F.array_sort(F.array_distinct("bounds_")).alias("bounds_"))


def with_row_id(df: DataFrame, order: str) -> DataFrame:
    """``row_id`` from 0 in ``order``. Rows are numbered within ranges of the order and shifted by the rows of earlier
    ranges, so that no task holds all of them. Sizes and rows are read apart, so that bounds of ranges are fixed first:
    ``repartitionByRange`` would draw other ones for each."""
    ranges = 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = F.array(*(F.lit(1 << b) for b in range(ranges.bit_length(), -1, -1)))

    def halve(at: Column, step: Column) -> Column:
        below = F.get("bounds_", at + step - 1) <= F.col(order)
        return F.when(F.coalesce(below, F.lit(False)), at + step).otherwise(at)

    parts = df.crossJoin(F.broadcast(range_bounds(df, order, ranges))).withColumn("pid", F.aggregate(steps, F.lit(0), halve)).drop("bounds_")
    sizes = parts.groupBy("pid").agg(F.count("*").alias("n"))
    before = sizes.select("pid", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    numbered = parts.withColumn("place", F.row_number().over(Window.partitionBy("pid").orderBy(order)) - 1)
    return numbered.join(F.broadcast(before), "pid").withColumn("row_id", F.col("before") + F.col("place")).drop("pid", "place", "before")


def column_union(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The columns of both for rows of equal key; a column that both have must agree, null and NaN with itself."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    other = right.withColumnsRenamed({c: f"{c}__right" for c in shared})
    out = left.join(other, key)
    for c in shared:
        bad = F.raise_error(F.concat(F.lit(f"{c} differs for key "), F.col(key).cast("string"))).cast(left.schema[c].dataType)
        out = out.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"{c}__right")), F.col(c)).otherwise(bad)).drop(f"{c}__right")
    return out


def membership(df: DataFrame, key: str, other: DataFrame, other_key: str, flag: str) -> DataFrame:
    ids = other.select(F.col(other_key).alias(key)).distinct().withColumn(flag, F.lit(True))
    return df.join(ids, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def lookup_lists(rows: DataFrame, key: str, ids: str, items: DataFrame, item_key: str, value: str, out: str) -> DataFrame:
    """Values for each row's list of ids, in the list's order; an id that isn't there is an error."""
    spread = rows.select(key, F.posexplode(ids).alias("at", item_key))
    found = spread.join(items.select(item_key, F.col(value).alias("found"), F.lit(True).alias("there")), item_key, "left")
    checked = F.when(F.col("there"), F.col("found")).otherwise(F.raise_error(F.concat(F.lit("no item "), F.col(item_key).cast("string"))).cast(items.schema[value].dataType))
    return gathered(found.withColumn("found", checked), [key], "at", "found", out)


def gathered(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    rows = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias(out))
    return rows.withColumn(out, F.transform(out, lambda e: e[value]))


def repeated(rows: DataFrame, times: Column, copy: str = "copy") -> DataFrame:
    """Each row ``times`` over, numbered from 0."""
    return rows.withColumn(copy, F.explode(F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))))


def pad_to_divisor(rows: DataFrame, divisor: int) -> tuple[DataFrame, int]:
    """Leading rows are appended, cyclically, until the count divides; returns how many."""
    n = rows.count()
    pad = -n % divisor if n else 0
    times = F.ceil((F.lit(pad) - F.col("row_id")) / F.lit(max(n, 1))).cast("int")
    more = repeated(rows.where(F.col("row_id") < pad), times, "copy").withColumn("row_id", n + F.col("copy") * n + F.col("row_id")).drop("copy")
    return rows.unionByName(more), pad


def unpad(rows: DataFrame, pad: int) -> DataFrame:
    return rows.where(F.col("row_id") < rows.count() - pad)


def pad_with_last(rows: DataFrame, n: int, first: bool = False) -> DataFrame:
    """``n`` copies of the last (or first) row at the end."""
    total = rows.count()
    one = rows.where(F.col("row_id") == (0 if first else total - 1))
    return rows.unionByName(repeated(one, F.lit(n), "copy").withColumn("row_id", (total + F.col("copy")).cast("bigint")).drop("copy"))


def sliced(rows: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    i = F.col("row_id")
    return rows.where((i >= start) & (i < stop) & ((i - start) % step == 0))


def reordered(rows: DataFrame, order: DataFrame) -> DataFrame:
    """Rows by a permutation (place, row_id): the row at ``place`` is the one of that ``row_id``."""
    return rows.join(order, "row_id").drop("row_id").withColumnRenamed("place", "row_id")


def inverse(order: DataFrame) -> DataFrame:
    return order.select(F.col("row_id").alias("place"), F.col("place").alias("row_id"))


def split_rows(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("part", F.floor(F.col("row_id") / size))


def chunks(rows: DataFrame, k: int, padded: bool = False) -> DataFrame:
    """``k`` equal chunks; rows that don't divide are an error unless padding is allowed."""
    n = rows.count()
    if n % k and not padded:
        raise ValueError(f"{n} rows don't divide into {k} chunks")
    return rows.withColumn("chunk", F.floor(F.col("row_id") / max(1, -(-n // k))))


def concat(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def pop(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The columns, and the rest."""
    return rows.select(*columns), rows.drop(*columns)


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.withColumnsRenamed(names)


def fold(rows: DataFrame, size: int) -> DataFrame:
    """Every ``size`` consecutive rows as one nested row."""
    inner = F.struct("row_id", *(c for c in rows.columns if c != "row_id"))
    return rows.groupBy(F.floor(F.col("row_id") / size).alias("fold")).agg(F.array_sort(F.collect_list(inner)).alias("rows"))


def unfold(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("rows").alias("r")).select("r.*")


def column_chunks(rows: DataFrame, column: str, n: int, chunk: str) -> DataFrame:
    """An array column in ``n`` pieces, each a row with the other columns."""
    width = F.floor(F.size(column) / n).cast("int")
    spread = rows.withColumn(chunk, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return spread.withColumn(column, F.slice(column, F.col(chunk) * width + 1, width))


def append(rows: DataFrame, new: DataFrame, keep: Column) -> DataFrame:
    return rows.unionByName(new.where(keep))


def mini_batches(rows: DataFrame, size: int, epochs: int, check: bool = True) -> DataFrame:
    """``batch`` and ``epoch`` per row; a size that doesn't divide the rows is an error."""
    if check and rows.count() % size:
        raise ValueError(f"batches of {size} don't divide the rows")
    return repeated(rows.withColumn("batch", F.floor(F.col("row_id") / size)), F.lit(epochs), "epoch")


def flattened(df: DataFrame, sep: str = "/") -> DataFrame:
    """Leaves of nested structs as columns, named by their path with ``sep``; arrays and maps stay whole."""

    def leaves(kind: StructType, column: Column | None, path: str) -> list[Column]:
        out = []
        for f in kind.fields:
            c, name = (F.col(f"`{f.name}`") if column is None else column.getField(f.name)), path + f.name
            out += leaves(f.dataType, c, name + sep) if isinstance(f.dataType, StructType) else [c.alias(name)]
        return out

    return df.select(*leaves(df.schema, None, ""))
