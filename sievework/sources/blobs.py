"""Test cases packed as base64 of a deflated pickle of a JSON text, read without ever opening the pickle.

A pickle is walked by its opcodes. One that does no more than name a string is accepted and that string taken; anything
that could build, import or call is refused, and so is a stream that inflates beyond a limit."""

from __future__ import annotations

import base64
import binascii
import json
import pickle
import pickletools
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sievework.shipping import ship

#: Rows and bytes of an Arrow batch, where the session leaves Spark's defaults: packing and reading are workers of their
#: own, as many as there are steps in a task, and each holds a batch several times.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "1m")}
#: Bytes that a blob may inflate to.
MOST_BYTES = 256 << 20
STRINGS = {"SHORT_BINUNICODE", "BINUNICODE", "BINUNICODE8", "UNICODE"}
HARMLESS = {"PROTO", "FRAME", "MEMOIZE", "PUT", "BINPUT", "LONG_BINPUT", "STOP"}
CASES = "array<struct<input: string, output: string>>"


def pickled_text(data: bytes) -> str | None:
    """The only string of a pickle that holds nothing else."""
    found = None
    try:
        for opcode, value, _ in pickletools.genops(data):
            if opcode.name in STRINGS and found is None:
                found = value
            elif opcode.name not in HARMLESS:
                return None
    except (ValueError, IndexError, UnicodeError):
        return None
    return found


def inflated(data: bytes, most: int = MOST_BYTES) -> bytes | None:
    """A whole zlib stream of at most ``most`` bytes."""
    stream = zlib.decompressobj()
    try:
        out = stream.decompress(data, most)
    except zlib.error:
        return None
    return out if stream.eof and not stream.unconsumed_tail else None


def unpacked(text: str | None, most: int = MOST_BYTES) -> str | None:
    """The JSON text of a field that holds it plainly or packed; null for anything else."""
    if text is None:
        return None
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    try:
        data = inflated(base64.b64decode(text.encode(), validate=True), most)
    except (binascii.Error, UnicodeError):
        return None
    return None if data is None else pickled_text(data)


def packed(text: str | None) -> str | None:
    return None if text is None else base64.b64encode(zlib.compress(pickle.dumps(text))).decode()


def _each(f, text: Column) -> Column:
    spark = SparkSession.active()
    ship(spark)
    for key, (default, value) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)

    @pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return run(text)


def unpacked_cases(text: Column) -> Column:
    """The test cases (input, output) of a plain or packed field; null where it is refused."""
    return F.from_json(_each(unpacked, text), CASES)


def with_packed_tests(df: DataFrame, public: str, private: str, name: Column, out: str) -> DataFrame:
    """``df`` with all tests of both fields, inputs, outputs and the function's name, packed into ``out``; null where a
    field can't be read."""
    cases = df.withColumn("cases_", F.concat(unpacked_cases(F.col(public)), unpacked_cases(F.col(private))))
    both = F.struct(F.transform("cases_", lambda c: c["input"]).alias("inputs"), F.transform("cases_", lambda c: c["output"]).alias("outputs"), name.alias("fn_name"))
    text = F.when(F.col("cases_").isNotNull(), F.to_json(both, {"ignoreNullFields": "false"}))
    return cases.withColumn(out, _each(packed, text)).drop("cases_")
