"""Quality rules: counts within a document, and lines that many documents of a host share.

A line is normalised (lower case, digits to 0, runs of white space to one space, trimmed) and hashed. For each host and
line the distinct documents (doc_id) that hold it are counted; copies count, unless ``by_text`` makes the documents of a
host with the same text one. A line above the host's limit, ``max(MIN_DOCS, SHARE of the host's documents)``, is
removed from the host's documents, and a document that loses more than DEPLETED of its words is rejected.

All on DataFrame functions. What is shuffled are hashes, counts and digests; a text is never moved. A hot line or host is
counted in parts before the shuffle; the join of lines with frequent lines is a plain inner join whose hot partitions
adaptive execution splits.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; rows that repeat a
document count as one document and each gets its verdict; rows without a doc_id are one document per text; an empty table gives no rows; texts of any length and any number
of lines are taken whole; names of other columns don't matter, those of the result replace equal ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import cut, words

#: A line is frequent in more than this many documents of a host, and more than this share of them.
MIN_DOCS, SHARE = 20, 0.01
#: A document that loses more than this share of its words is rejected.
DEPLETED = 0.5
#: Base rules: fewest words, most percent of words in repeated 3-word windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Bytes up to which the table of texts with frequent lines is broadcast, at ROW_BYTES a text and 8 a line; a larger one
#: is joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 32 << 20, 120
#: What stands for a null doc_id.
NO_ID = -(1 << 63)
BLANK = r"^[\x20\x09-\x0D]*$"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(w: Column) -> Column:
    """Words in a 3-word window that occurs twice or more in the array ``w``; windows are compared by 64-bit hashes."""

    def covered(hashes: Column) -> Column:
        spots = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def again(s: Column) -> Column:
            same = lambda x, i, d: F.coalesce(F.get(s, i + d)["h"] == x["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, i, -1) | same(x, i, 1))

        places = F.sort_array(F.transform(let(spots, again), lambda x: x["i"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
        step = lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    starts = F.sequence(F.lit(0), F.size(w) - 3)
    hashes = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    counted = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(counted)


def base_counts(text: Column) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text."""
    filled = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(filled, "\n"), lambda x: ~x.rlike(BLANK))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(filled, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )


def normal_line(line: Column) -> Column:
    bare = F.btrim(F.lower(line), F.lit(" \t\n\x0b\x0c\r"))
    return F.regexp_replace(F.regexp_replace(bare, "[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """host, text_id, line (hash), docs, words: the normalised lines of each distinct text of a host, with the documents
    that have the text and the line's words summed over all its rows."""
    line = F.explode(F.transform(F.split("text", "\n"), normal_line)).alias("line")
    doc = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")
    rows = docs.where(F.col("text").isNotNull()).select(F.col(host).alias("host"), F.md5("text").alias("text_id"), doc, line).where("line <> ''")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "))) + 1
    hashed = rows.select("host", "text_id", "doc", F.xxhash64("line").alias("line"), n.cast("long").alias("n"))
    return hashed.groupBy("host", "line", "text_id").agg(F.count_distinct("doc").alias("docs"), F.sum("n").alias("words"))


def removed_lines(lines: DataFrame, by_text: bool = False) -> DataFrame:
    """Rows of ``lines`` above their host's limit."""
    n = F.lit(1) if by_text else F.col("docs")
    sizes = lines.groupBy("host", "text_id").agg(F.max(n).alias("n")).groupBy("host").agg(F.sum("n").alias("all_docs"))
    often = lines.groupBy("host", "line").agg(F.sum(n).alias("with_line")).where(F.col("with_line") > MIN_DOCS)
    frequent = often.join(sizes, often["host"].eqNullSafe(sizes["host"])).where(F.col("with_line") > SHARE * F.col("all_docs"))
    frequent = frequent.select(often["host"].alias("f_host"), F.col("line").alias("f_line"))
    return lines.join(frequent, lines["host"].eqNullSafe(frequent["f_host"]) & (lines["line"] == frequent["f_line"])).drop("f_host", "f_line")


def quality(docs: DataFrame, host: str = "source", by_text: bool = False) -> DataFrame:
    """doc_id, host, text_id, the base counts, base_failed, depleted and kept of every document."""
    counted = docs.select("doc_id", F.col(host).alias("host"), F.md5("text").alias("text_id"), base_counts(F.col("text")).alias("c"))
    counted = cut(counted.select("doc_id", "host", "text_id", "c.*"))
    removed = removed_lines(cut(host_lines(docs, host)), by_text)
    lost = removed.groupBy("host", "text_id").agg(F.sum("words").alias("lost"))
    whole = counted.groupBy("host", "text_id").agg(F.sum("n_words").alias("words"))
    both = lost.join(whole, lost["host"].eqNullSafe(whole["host"]) & (lost["text_id"] == whole["text_id"]))
    bad = both.where(F.col("lost") > DEPLETED * F.col("words")).select(lost["host"].alias("d_host"), lost["text_id"].alias("d_text"), F.lit(True).alias("depleted"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = counted.join(bad, counted["host"].eqNullSafe(bad["d_host"]) & (counted["text_id"] == bad["d_text"]), "left")
    out = out.withColumns({"base_failed": failed, "depleted": F.coalesce("depleted", F.lit(False))})
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("depleted")).drop("d_host", "d_text")


def kept_documents(docs: DataFrame, host: str = "source", by_text: bool = False) -> DataFrame:
    """The documents that pass, without the lines above their host's limit; n_chars, if there, follows the text. The base
    rules judge the text as it came, as in ``quality``; what is left isn't judged again."""
    lines = cut(host_lines(docs, host))
    removed = removed_lines(lines, by_text)
    gone = cut(removed.groupBy("host", "text_id").agg(F.collect_set("line").alias("gone")))
    gone = gone.select(F.col("host").alias("g_host"), F.col("text_id").alias("g_text"), "gone")
    size = gone.agg(F.sum(ROW_BYTES + 8 * F.size("gone") + F.coalesce(F.length("g_host"), F.lit(0)))).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text", F.col(host).alias("host"), F.md5("text").alias("text_id"))
    rows = rows.join(gone, rows["host"].eqNullSafe(gone["g_host"]) & (rows["text_id"] == gone["g_text"]), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("gone"), F.xxhash64(normal_line(x)))), "\n")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(left)
    counts = let(words(F.col("text")), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("repeated")))

    def passes(c: Column) -> Column:
        fails = (c["n"] < MIN_WORDS) | (100 * c["repeated"] > MAX_REPEAT_PERCENT * c["n"])
        depleted = F.col("gone").isNotNull() & (c["n"] - F.size(words(left)) > DEPLETED * c["n"])
        return ~fails & ~depleted

    passed = rows.where(let(counts, passes)).select("row", text.alias("left"))
    row = F.col("row").withField("text", F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    return passed.select(row.alias("row")).select("row.*")
