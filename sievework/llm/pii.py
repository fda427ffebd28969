"""Personal data: base kinds by pattern, further identifiers by bootstrapped contexts.

Base kinds (email, ip, card, phone) are found leftmost and without overlap per kind; matches that fail their kind's
check are dropped. They are seeds of a bootstrap, and so are random-looking strings: RANDOM letters and digits or more
that change from one to the other SWITCHES times. A candidate is a token with a digit or an at sign, or a run of tokens of
digits and their punctuation; its ``core`` is what is left without quotes and a label such as ``name=``. Every candidate
is an instance of up to six lexical patterns: its shape (alphabet and length, or classes of characters) with one, two or
three words before it, with the words on both sides, with its label, or with its own first four letters.

Patterns and instances form a graph. In each of ROUNDS rounds a pattern's confidence is the share of its occurrences
whose instances are known, if it has MIN_INSTANCES distinct known ones; an instance is known once the confidences of its
patterns, combined as independent evidence, reach ACCEPT. Known instances behind confident patterns are spans of the kind
``id``; those that overlap a base span, are shorter than MIN_LENGTH or are what a base kind's check has dropped are left
out. A random-looking string that no confident pattern holds is no span.

All on DataFrame functions. Texts are read, never moved: the graph has a row per distinct pair, counted in parts, and
64-bit hashes stand for patterns and instances, which meet through equi-joins that adaptive execution can split.

Regular expressions are written with possessive quantifiers and a look behind to a run's start, which changes no match
and keeps the time linear in the text. Offsets are code points, ends exclusive; they are summed in blocks of the square
root of their number, as a fold that appends would take the square.

Defined cases: a null text is empty; rows that repeat a document are judged alike; a null doc_id is kept; an empty table
gives no rows; extra columns are ignored, except that ``redacted`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import cut

#: Kinds in the order in which spans of one start are listed.
KINDS = ("email", "ip", "card", "phone", "id")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for its pattern to be tried.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
#: Candidates: tokens of digits and punctuation, up to six in a row, or a token with a digit or an at sign.
_DIGITS = r"(?=[().+-]*[0-9])[0-9().+-]++(?![^\x20\x09-\x0D])"
TOKEN = r"(?<![^\x20\x09-\x0D])(?:" + _DIGITS + r"(?:\x20" + _DIGITS + r"){0,5}+|[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+)"
#: What comes before a core: a name with = or :, quotes and brackets.
LABEL = r"^(?:[^0-9@=:]*+[=:])?+[\"'(\[{<]*+"
#: A core ends at a quote or a closing bracket; punctuation and markup at its end are no part of it.
CORE = r"^[^\"')\]}<>]*+"
#: Characters of context looked at beside a candidate, fewest characters of an instance.
CONTEXT, MIN_LENGTH = 96, 5
#: Fewest characters and changes between letters and digits of a random-looking seed.
RANDOM, SWITCHES = 16, 4
ROUNDS, MIN_INSTANCES, MIN_CONFIDENCE, ACCEPT = 3, 5, 0.6, 0.5
#: Texts with added spans up to which their table is broadcast, at ADDED_BYTES a span.
BROADCAST_BYTES, ADDED_BYTES = 16 << 20, 80
SPAN = "array<struct<start:int,end:int,kind:int>>"
#: Code points per piece in which a text is cut for masking.
PIECE = 4096


def let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column, joined_by) -> Column:
    """For each element of an array of int from 0 up, and once more at its end, the sum, or the largest, of those before."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("before"))
        return F.aggregate(block, start, lambda a, x: F.struct(joined_by(a["total"], x).alias("total"), F.concat(a["before"], F.array(a["total"])).alias("before")))

    def joined(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
        step = lambda a, p: F.struct(joined_by(a["at"], p["total"]).alias("at"), F.concat(a["out"], F.array(F.transform(p["before"], lambda v: joined_by(v, a["at"])))).alias("out"))
        return F.aggregate(parts, start, step, lambda a: F.flatten(a["out"]))

    def dealt(x: Column) -> Column:
        each = x["each"]
        return joined(F.transform(F.sequence(F.lit(0), F.floor((F.size(x["all"]) - 1) / each).cast("int")), lambda b: within(F.slice(x["all"], b * each + 1, each))))

    more = F.concat(sizes, F.array(F.lit(0)))
    return let(more, lambda x: let(F.struct(x.alias("all"), F.ceil(F.sqrt(F.size(x))).cast("int").alias("each")), dealt))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match, before, after) for the matches of a pattern, with the text next to them up to
    another match."""
    pieces = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))

    def walk(p: Column) -> Column:
        steps = F.sequence(F.lit(0), F.size(p["hits"]) - 1)
        sizes = F.transform(steps, lambda i: F.length(F.get(p["gaps"], i)) + F.length(F.get(p["hits"], i)))

        def rows(before: Column) -> Column:
            def row(i: Column) -> Column:
                gap, hit = F.get(p["gaps"], i), F.get(p["hits"], i)
                start = F.get(before, i) + F.length(gap)
                return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("match"), F.right(gap, F.lit(CONTEXT)).alias("before"), F.left(F.get(p["gaps"], i + 1), F.lit(CONTEXT)).alias("after"))

            return F.transform(steps, row)

        empty = F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>")
        return F.when(F.size(p["hits"]) == 0, empty).otherwise(let(running(sizes, lambda x, y: x + y), rows))

    return let(pieces, walk)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        digit = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, digit).otherwise(2 * digit - F.when(digit > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: let(F.ltrim(p, F.lit("0")), lambda x: F.when(F.length(x) > 3, False).otherwise(F.coalesce(F.try_to_number(F.concat(F.lit("0"), x), F.lit("9999")), F.lit(0)) <= 255))
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Base spans of a text in order, as SPAN."""
    text = F.coalesce(text, F.lit(""))

    def found(k: int) -> Column:
        kind = KINDS[k]
        good = F.filter(located(text, PATTERNS[kind]), lambda s: _valid(kind, s["match"]))
        spans = F.transform(good, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind")))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast(SPAN))

    return F.array_sort(F.flatten(F.array(*map(found, range(4)))), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def shape(core: Column) -> Column:
    """Alphabet and length of a string of letters and digits, else its classes of characters, runs as one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(core, r"\p{L}", "a"), "[0-9]", "0"), r"(.)\1++", "$1")
    kind = F.when(core.rlike("^[0-9]+$"), "digits").when(core.rlike("^[0-9a-f]+$"), "hex").when(core.rlike("^[0-9A-Z]+$"), "upper").when(core.rlike("^[0-9A-Za-z]+$"), "mixed")
    return F.coalesce(F.concat(kind, F.length(core).cast("string")), plain)


def _word(text: Column, k: int) -> Column:
    """The ``k``-th word before the end of ``text``, in lower case; empty if it isn't whole."""
    return F.lower(F.regexp_extract(text, r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)" + r"[\x20\x09-\x0D]+[^\x20\x09-\x0D]+" * (k - 1) + r"[\x20\x09-\x0D]+$", 1))


def _patterns(t: Column) -> Column:
    """Hashes of the patterns of a candidate (core, label, before, after)."""
    words = F.struct(_word(t["before"], 1).alias("a"), _word(t["before"], 2).alias("b"), _word(t["before"], 3).alias("c"), F.lower(F.regexp_extract(t["after"], r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D])", 1)).alias("d"), shape(t["core"]).alias("s"))

    def named(w: Column) -> Column:
        a, b, c, d, form = w["a"], w["b"], w["c"], w["d"], F.concat_ws("\x01", t["label"], w["s"])
        made = lambda k, *x: F.xxhash64(F.lit(k), *x, form)
        letters = F.left(t["core"], F.lit(4))
        return F.filter(
            F.array(
                F.when(a != "", made(1, a)), F.when(b != "", made(2, b, a)), F.when(c != "", made(3, c, b, a)), F.when((a != "") & (d != ""), made(4, a, d)),
                F.when(t["label"].rlike(r"\p{L}"), made(5)), F.when(letters.rlike("^[A-Za-z]{4}$") & (F.length(t["core"]) >= 3 * 4), made(6, letters)),
            ),
            lambda x: x.isNotNull(),
        )

    return let(words, named)


def _random(core: Column) -> Column:
    return core.rlike("^[0-9A-Za-z]{%d,}$" % RANDOM) & (F.regexp_count(core, F.lit("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")) >= SWITCHES)


def _dropped(core: Column) -> Column:
    """Whether a core looks like a base kind; one that isn't a base span failed its check."""
    return (core.rlike(r"^[0-9](?:[\x20-]?[0-9])++$") & F.length(_digits(core)).between(12, 19)) | core.rlike(r"^[0-9]++(?:\.[0-9]++){3,}+$")


CANDIDATES = "array<struct<start:int,end:int,instance:bigint,patterns:array<bigint>,random:boolean>>"


def candidates(text: Column) -> Column:
    """Candidates of a text as CANDIDATES."""
    text = F.coalesce(text, F.lit(""))

    def stripped(s: Column) -> Column:
        numeric = s["match"].rlike(r"^[0-9().+\x20-]+$")
        label = F.when(numeric, F.lit("")).otherwise(F.regexp_extract(s["match"], LABEL, 0))
        core = F.when(numeric, F.rtrim(s["match"], F.lit(".-"))).otherwise(F.rtrim(F.regexp_extract(F.substring(s["match"], F.length(label) + 1, F.length(s["match"])), CORE, 0), F.lit(".,;:!?#*$%&|")))
        return F.struct(s["start"], F.lower(label).alias("label"), core.alias("core"), s["before"], s["after"])

    def row(t: Column) -> Column:
        start = t["start"] + F.length(t["label"])
        return F.struct(start.alias("start"), (start + F.length(t["core"])).alias("end"), F.xxhash64(t["core"]).alias("instance"), _patterns(t).alias("patterns"), _random(t["core"]).alias("random"), _dropped(t["core"]).alias("dropped"))

    found = F.transform(F.transform(located(text, TOKEN), stripped), row)
    return F.when(text.rlike("[0-9@]"), F.filter(found, lambda t: t["end"] - t["start"] >= MIN_LENGTH)).otherwise(F.array())


def read_candidates(docs: DataFrame) -> DataFrame:
    """doc_id, text_id, base (SPAN) and ``found``: the candidates with their patterns, whether they are seeds, and whether
    they may be reported (``free``)."""
    rows = docs.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("text_id"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("found"))

    def judged(known: Column) -> Column:
        """Whether a base span that begins before a candidate's end reaches its start, by binary search."""

        def one(t: Column) -> Column:
            begun = F.aggregate(F.array(*(F.lit(1 << k) for k in range(26, -1, -1))), F.lit(0), lambda at, k: F.when(F.coalesce(F.get(known["base"], at + k - 1)["start"] < t["end"], F.lit(False)), at + k).otherwise(at))
            inside = F.get(known["reach"], begun) > t["start"]
            return let(inside, lambda x: F.struct(t["start"], t["end"], t["instance"], t["patterns"], (x | t["random"]).alias("seed"), (~x & ~t["dropped"]).alias("free")))

        return F.transform(known["found"], one)

    known = F.struct("base", "found", running(F.transform("base", lambda b: b["end"]), F.greatest).alias("reach"))
    return cut(rows.select("doc_id", "text_id", "base", let(known, judged).alias("found")))


def bootstrap(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The confident patterns (pattern) and the known instances (instance), from what ``read_candidates`` gives."""
    each = rows.select(F.explode("found").alias("t")).select("t.instance", "t.seed", F.explode("t.patterns").alias("pattern"))
    pairs = cut(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n")))
    often = pairs.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("total")).where(F.col("instances") >= MIN_INSTANCES).select("pattern", "total")
    edges = cut(pairs.join(often, "pattern"))
    known = cut(edges.where("seed").select("instance").distinct())
    trusted = None
    for _ in range(ROUNDS):
        marked = edges.join(known.withColumn("known", F.lit(True)), "instance", "left")
        score = marked.groupBy("pattern").agg(F.count_if("known").alias("instances"), (F.sum(F.when(F.col("known"), F.col("n"))) / F.first("total")).alias("confidence"))
        trusted = cut(score.where((F.col("instances") >= MIN_INSTANCES) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern", "confidence"))
        doubt = F.sum(F.log(F.greatest(F.lit(1e-9), 1.0 - F.col("confidence"))))
        accepted = edges.join(trusted, "pattern").groupBy("instance").agg(doubt.alias("doubt")).where(1.0 - F.exp("doubt") >= ACCEPT).select("instance")
        known = cut(known.unionByName(accepted).distinct())
    return trusted.select("pattern"), known


def added_spans(rows: DataFrame) -> DataFrame:
    """doc_id, text_id, added (SPAN) of the documents with known instances behind confident patterns."""
    trusted, known = bootstrap(rows)
    seen = rows.select("doc_id", "text_id", F.explode("found").alias("t")).where("t.free").select("doc_id", "text_id", "t.start", "t.end", "t.instance", F.explode("t.patterns").alias("pattern"))
    backed = seen.join(trusted, "pattern", "left_semi").join(known, "instance", "left_semi")
    spans = backed.select("doc_id", "text_id", F.struct("start", "end", F.lit(4).alias("kind")).alias("s"))
    return cut(spans.groupBy("doc_id", "text_id").agg(F.array_sort(F.collect_set("s")).alias("added")))


def _with_added(rows: DataFrame, added: DataFrame) -> DataFrame:
    size = added.agg(F.sum((F.size("added") + 1) * ADDED_BYTES)).first()[0] or 0
    more = added.select(F.col("doc_id").alias("a_doc"), F.col("text_id").alias("a_text"), "added")
    more = F.broadcast(more) if size <= BROADCAST_BYTES else more
    joined = rows.join(more, rows["doc_id"].eqNullSafe(more["a_doc"]) & (rows["text_id"] == more["a_text"]), "left").drop("a_doc", "a_text")
    return joined.withColumn("spans", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "added")))).drop("added")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (SPAN; ``kind`` is a place in KINDS) of every document."""
    rows = read_candidates(docs)
    return _with_added(rows, added_spans(rows)).select("doc_id", "base", "spans")


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by its first kind in brackets. The text is cut
    into pieces once, so that a span costs a piece's length, not the text's."""
    kinds = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def between(pieces: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
        head = F.coalesce(F.get(pieces, first), F.lit(""))
        near = F.substring(head, a % PIECE + 1, b - a)
        far = F.concat(F.substring(head, a % PIECE + 1, F.lit(PIECE)), F.array_join(F.slice(pieces, first + 2, F.greatest(F.lit(0), last - first - 1)), ""), F.substring(F.coalesce(F.get(pieces, last), F.lit("")), F.lit(1), b % PIECE))
        return F.when(first == last, near).otherwise(far)

    def joined(p: Column) -> Column:
        """A span starts a run if no earlier one reaches it."""
        s, pieces, ends = p["spans"], p["pieces"], F.transform(p["spans"], lambda x: x["end"])

        def parts(reach: Column) -> Column:
            runs = F.transform(s, lambda x, i: F.when(x["start"] >= F.get(reach, i), F.concat(between(pieces, F.get(reach, i), x["start"]), F.get(kinds, x["kind"]))).otherwise(F.lit("")))
            return F.concat(F.array_join(runs, ""), between(pieces, F.get(reach, F.size(s)), F.length(text)))

        return let(running(ends, F.greatest), parts)

    whole = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)).alias("pieces"), spans.alias("spans"))
    return F.when(F.size(spans) > 0, let(whole, joined)).otherwise(text)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in ``text``; n_chars, if there, follows the text."""
    added = added_spans(read_candidates(docs))
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", F.md5(text).alias("text_id"), base_spans(F.col("text")).alias("base"))
    out = _with_added(own, added).select("row", F.when(F.col("text").isNotNull(), masked(F.col("text"), F.col("spans"))).alias("masked"))
    row = F.col("row").withField("text", F.col("masked"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("masked").cast(docs.schema["n_chars"].dataType))
    return out.select(row.alias("row")).select("row.*")
