"""Each operator against a brute-force version or the library it has to equal, on documents that are odd in every way:
null and empty values, long texts, ties, repeated rows, empty tables and extra columns with names the operators use."""

import base64
import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sievework.llm import ann, bpe, fm_index, minhash, mixing, pii, quality_rules, queries, stages, stupid_backoff, substrings, token_ids, warc
from sievework.llm.components import components
from sievework.llm.shared import fresh_dir, range_shards

PATH = public_tokenizers.path("word_bpe_49k.json")
EXTRA = "node long, key long, shard int, spans string, ids string, target double, gone string, row string, n long, mini long, base string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def texts():
    rnd = random.Random(5)
    vocab = ["the", "of", "and", "Été", "naïve", "blue", "sea", "x1", "don't", "stop.", "Σίσυφος", "end,", "42", "ﬁne", "日本", "run"]
    make = lambda n: " ".join(rnd.choice(vocab) + str(rnd.randint(0, 40)) * (rnd.random() < 0.7) for _ in range(n))
    base, passage = make(120), make(40)
    words = base.split()
    near = [" ".join([*words[:k], "changed", *words[k + 1 :]]) for k in (3, 60, 110)]
    odd = [None, "", "   \n\t ", "one", "a b c", "İ <|endoftext|> x<|startoftext|>y", "tab\x0bvt\x0cff\x1cfs\x85nel nbsp", "same same same same same same"]
    mail = "write to ann.b@mail.example.com or +1 (434) 555-2368 from 10.0.0.255 with 4111 1111 1111 1111 not 4111 1111 1111 1112 nor 1.2.3.999"
    return [*odd, base, base, *near, make(80) + " " + passage, make(50) + "\n" + passage + "\n" + make(30), passage, mail, make(3000), "z" * 5000, " ".join(["loop the loop"] * 60), make(200), make(19), make(20)]


@pytest.fixture(scope="module")
def rows():
    out = [(i, t, "en", [None, "b", "a", "a"][i % 4], None if t is None else len(t), *[None] * 11) for i, t in enumerate(texts())]
    return [*out, out[9], out[12]]  # two rows repeat


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return [w.decode() for w in (t or "").encode().split()]


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_quality(docs, none, rows):
    got = by_id(quality_rules.quality(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for doc_id, text, *_ in rows:
        w = words(text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed, not failed)
        assert got[doc_id] == want, (doc_id, got[doc_id], want)
    assert quality_rules.quality(none).count() == 0 and quality_rules.kept_documents(none).count() == 0
    assert sorted(r["doc_id"] for r in quality_rules.kept_documents(docs).collect()) == sorted(r[0] for r in rows if got[r[0]][-1])


def test_quality_removes_lines_of_a_host_and_rejects_depleted(spark):
    letters = lambda n: "".join(chr(97 + int(d)) for d in str(n))
    filler = lambda i: " ".join(f"w{letters(i)}x{letters(k)}" for k in range(60))
    line = " ".join(f"menu{letters(k)}" for k in range(200))
    data = [(i, f"{filler(i)}\n{line if i < 30 else 'short menu'}", "h") for i in range(60)] + [(99, f"{filler(99)}\n{line}", "other")]
    data += [(1000 + i, filler(7000), "copies") for i in range(50)] + [(2000 + i, filler(7001), "rows") for i in range(15) for _ in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    kept = by_id(quality_rules.quality(df), "kept")
    assert [i for i, k in kept.items() if not k[0]] and all(kept[i][0] == (i >= 30) for i in range(60)) and kept[99][0]
    assert not kept[1000][0] and kept[2000][0]  # fifty documents share their lines; rows that repeat a document are one
    assert by_id(quality_rules.quality(df, by_text=True), "kept")[1000][0]
    left = {r["doc_id"]: r["text"] for r in quality_rules.kept_documents(df).collect()}
    assert left[45] == filler(45) and left[99].endswith(line) and 5 not in left and 1000 not in left
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("documents", df.dropDuplicates(["doc_id"]).toPandas())
    want = {r[0]: r[1] for r in con.sql(f"SELECT doc_id, kept FROM ({queries.ORACLE_SQL['op2_quality_rules']})").fetchall()}
    assert {i: k for i, (k,) in kept.items()} == want and sum(want.values()) < len(want) - 50


def test_minhash(docs, none, rows):
    for n in (4, 5):
        sets = {}
        for doc_id, text, *_ in rows:
            w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
            sets[doc_id] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
        parent = {i: i for i in sets}

        def root(i, parent=parent):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in itertools.combinations(sorted(sets), 2):
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
        got = by_id(minhash.near_duplicates(docs, n), "n_shingles", "component_id", "kept")
        assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_large_group_is_joined_by_chains(spark):
    rnd = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    data, w = [], list(base)
    for i in range(120):  # each differs from the one before by a word, from the first by many
        w[rnd.randrange(100)] = f"n{i}"
        data.append((i, " ".join(w)))
    got = by_id(minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), 4), "component_id")
    assert {c for (c,) in got.values()} == {0}


def test_components(spark):
    rnd = random.Random(8)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(100, i) for i in range(300, 400)]
    loose = [(rnd.randrange(1000, 1400), rnd.randrange(1000, 1400)) for _ in range(180)]
    edges = [*chain, *star, *loose, (7, 7), (5, -9), (-9, 5), (5, -9), (2**62, 3), (259, 399)]
    least = {x: x for e in edges for x in e}
    for _ in least:
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    want = {x: m for x, m in least.items() if x != m}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for limit in (1 << 18, 100, 5, 1):  # one task, stars until few edges are left, stars to their end
        rows = components(df, limit).collect()
        assert {r["node"]: r["component"] for r in rows} == want and len(rows) == len(want)
    assert components(df.where("a = b")).count() == components(df.limit(0)).count() == 0


def test_minhash_documents_with_several_texts(spark):
    rnd = random.Random(11)
    make = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    a, b, c = make(), make(), make()
    near = lambda w: " ".join([*w[:-1], "changed"])
    data = [(5, " ".join(a)), (5, " ".join(b)), (5, " ".join(b)), (7, near(a)), (9, " ".join(b)), (12, near(b)), (3, " ".join(c)), (3, " ".join(c)), (20, "few"), (None, " ".join(c)), (21, None), (21, near(c))]
    schema = "doc_id long, text string"
    for parts in (1, 5):
        got = by_id(minhash.near_duplicates(spark.createDataFrame(data, schema).repartition(parts).where("doc_id IS NOT NULL AND doc_id <> 21"), 4), "component_id")
        assert got == {5: (5,), 7: (5,), 9: (5,), 12: (5,), 3: (3,), 20: (20,)}
    rows = minhash.near_duplicates(spark.createDataFrame(data, schema), 4).collect()
    assert sorted(r["component_id"] for r in rows if r["doc_id"] == 21) == [3, 21]
    left = stages.near_dedup(spark, spark.createDataFrame(data[:10], schema), "")
    assert Counter(map(tuple, left.collect())) == Counter({data[0]: 1, data[1]: 1, data[6]: 1, data[8]: 1, data[9]: 1})


def test_pii(docs, none, rows):
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in pii.find(docs).collect()}
    for doc_id, text, *_ in rows:
        want = sorted((m.start(), k, m.end()) for k, kind in enumerate(patterns) for m in re.finditer(patterns[kind], text or "") if valid(kind, m[0]))
        assert got[doc_id] == want
    assert pii.find(none).count() == 0 and pii.redacted(none).count() == 0
    left = by_id(pii.redacted(docs), "text")
    assert left[16] == ("write to [EMAIL] or [PHONE] from [IP] with [CARD] not 4111 1111 1111 1112 nor 1.2.3.999",) and left[0] == (None,) and left[8][0] == rows[8][1]


def test_pii_edges(spark):
    odd = ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 2 3 4 5 6 7 8 9-", "é1@x.y ünd 00001.2.3.4", "7" * 4000, "a" * 20000 + " b@c.d", "+123456789+123456789"]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["base"]] for r in pii.find(df).collect()}
    assert got[0] == [(0, 5, 0), (5, 11, 0)]
    assert got[1] == [(0, 7, 1), (8, 15, 1)] and got[3][0] == (1, 6, 0) and got[3][1][2] == 1 and got[4] == [] and got[5] == [(20001, 20006, 0)]


def brute_bootstrap(data):
    """The spans of the kind id per document, by plain loops over the same definitions."""
    digits = r"(?=[().+-]*[0-9])[0-9().+-]+(?!\S)"
    token = re.compile(rf"(?<!\S)(?:{digits}(?:\x20{digits}){{0,5}}|\S*[0-9@]\S*)")
    base = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }

    def valid(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    def form(core):
        for name, chars in (("digits", "[0-9]+"), ("hex", "[0-9a-f]+"), ("upper", "[0-9A-Z]+"), ("mixed", "[0-9A-Za-z]+")):
            if re.fullmatch(chars, core):
                return f"{name}{len(core)}"
        return re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub(r"[^\W\d_]", "a", core)))

    found = []  # document, start, end, core, patterns, seed, free
    for doc, text in data:
        spans = [m.span() for kind, p in base.items() for m in re.finditer(p, text) if valid(kind, m[0])]
        hits = list(token.finditer(text))
        for k, m in enumerate(hits):
            gap = text[hits[k - 1].end() if k else 0 : m.start()]
            after = text[m.end() : hits[k + 1].start() if k + 1 < len(hits) else len(text)]
            numeric = re.fullmatch(r"[0-9().+\x20-]+", m[0])
            label = "" if numeric else re.match(r"(?:[^0-9@=:]*[=:])?[\"'(\[{<]*", m[0])[0]
            core = m[0].rstrip(".-") if numeric else re.match(r"[^\"')\]}<>]*", m[0][len(label) :])[0].rstrip(".,;:!?#*$%&|")
            if len(core) < 5:
                continue
            start = m.start() + len(label)
            w = [""] * 3 + gap.lower().split()
            b, label, s = w[::-1][:3], label.lower(), form(core)
            right = re.match(r"\s+(\S+)(?=\s)", after)
            patterns = {(1, b[0], label, s) if b[0] else None, (2, b[1], b[0], label, s) if b[1] else None, (3, *b, label, s) if b[2] else None}
            patterns |= {(4, b[0], right[1].lower(), label, s) if b[0] and right else None, (5, label, s) if re.search(r"[^\W\d_]", label) else None}
            patterns |= {(6, core[:4], label, s) if re.match("[A-Za-z]{4}", core) and len(core) >= 12 else None}
            inside = any(x < start + len(core) and y > start for x, y in spans)
            random_ = re.fullmatch("[0-9A-Za-z]{16,}", core) and len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", core)) >= 4
            d = re.sub("[^0-9]", "", core)
            dropped = re.fullmatch(r"[0-9](?:[\x20-]?[0-9])+", core) and 12 <= len(d) <= 19 or re.fullmatch(r"[0-9]+(?:\.[0-9]+){3,}", core)
            found.append((doc, start, start + len(core), core, patterns - {None}, bool(inside or random_), not inside and not dropped))
    edges = Counter((p, f[3]) for f in found for p in f[4])
    instances = defaultdict(set)
    for p, i in edges:
        instances[p].add(i)
    known, trusted = {f[3] for f in found if f[5]}, {}
    known = {i for i in known if any(i in s and len(s) >= 5 for s in instances.values())}
    for _ in range(3):
        trusted = {}
        for p, s in instances.items():
            share = sum(edges[p, i] for i in s & known) / sum(edges[p, i] for i in s)
            if len(s & known) >= 5 and share >= 0.6:
                trusted[p] = share
        for i in {i for s in instances.values() for i in s}:
            if 1 - math.prod(max(1e-9, 1 - c) for p, c in trusted.items() if i in instances[p]) >= 0.5:
                known.add(i)
    out = defaultdict(set)
    for doc, start, end, core, patterns, _, free in found:
        if free and core in known and patterns & trusted.keys():
            out[doc].add((start, end))
    return {doc: sorted(out[doc]) for doc, _ in data}


def test_pii_bootstrap(spark):
    rnd = random.Random(8)
    filler = lambda n: " ".join(rnd.choice(["the", "of", "and", "room", "12", "in", "2004", "a1b", "was", "seen", "4.0."]) for _ in range(n))
    hexes = lambda n: "".join(rnd.choice("0123456789abcdef") for _ in range(n))
    data = []
    for i in range(40):
        data.append((i, f'{filler(20)} token = "{hexes(40)}" {filler(9)}'))
        data.append((100 + i, f"{filler(9)} password={hexes(18)} {filler(20)}"))
        data.append((200 + i, f"{filler(20)} AKIA{''.join(rnd.choice('ABCDEFGH234567') for _ in range(16))} {filler(5)}"))
        data.append((300 + i, f"{filler(5)} please call +1 ({rnd.randint(200, 999)}) 555-{rnd.randint(1000, 9999)} for more {filler(5)}"))
        data.append((400 + i, f"{filler(5)} mail to jane.{''.join(rnd.choice('abcdefg') for _ in range(5))}@example.org at {filler(5)}"))
        data.append((500 + i, filler(60)))
    data += [(600, filler(5) + ' token = "' + "a" * 20 + "12" + "b" * 18 + '" x'), (601, f"{filler(5)} password=abcdefabcdef123456 x"), (602, "please call +1 (974) 555-3 for more"), (603, f"lone {hexes(40)} here")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == 4] for r in pii.find(df).collect()}
    assert got == brute_bootstrap(data)
    text = dict(data)
    shown = {i: [text[i][a:b] for a, b in spans] for i, spans in got.items()}
    assert all(len(shown[i]) == 1 and len(shown[i][0]) == 40 for i in range(40)) and shown[601] == ["abcdefabcdef123456"] and len(shown[600]) == 1
    assert all(shown[200 + i][0].startswith("AKIA") for i in range(40)) and not any(shown[500 + i] for i in range(40)) and shown[603] == []
    assert shown[602] == ["+1 (974) 555-3"]  # too few digits for a phone, but where phones stand
    left = by_id(pii.redacted(df), "text")
    assert left[601][0].endswith("password=[ID] x") and all("[PHONE]" in left[300 + i][0] for i in range(40))


def test_pii_long_text_takes_linear_time(spark):
    text = " ".join(f"x{i}y@m.org" if i % 3 else f"1.2.3.{i % 256}" for i in range(40_000))
    df = spark.createDataFrame([(0, text)], "doc_id long, text string")
    pii.redacted(df).count()
    began = time.time()
    masked = pii.redacted(df).first()["text"]
    assert masked == " ".join("[EMAIL]" if i % 3 else "[IP]" for i in range(40_000))
    print('seconds', time.time() - began)
    assert time.time() - began < 20  # a fold that appends takes minutes


def test_mixing(docs, none, rows):
    got = [(r["doc_id"], r["source"], r["mix_size"], r["source_size"], r["target"], r["copies"]) for r in mixing.mix(docs).collect()]
    assert sorted(r[0] for r in got) == sorted(r[0] for r in rows)
    sizes = defaultdict(int)
    for _, text, _, source, *_ in rows:
        sizes[source] += len(words(text))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped, total = set(), sum(sizes.values())
    while True:
        level = (total - sum(3 * sizes[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * sizes[s]}
        if not new:
            break
        capped |= new
    for doc_id, source, size, source_size, target, copies in got:
        assert size == len(words(rows[doc_id][1])) and source_size == sizes[source] and 0 <= copies <= 3
        assert target == pytest.approx(3 * sizes[source] if source in capped else level * weight[source])
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    again = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(7)).collect())
    assert again == sorted((r[0], r[5]) for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns and mixing.mixed_documents(docs).count() == sum(r[5] for r in got if r[2])


def test_mixing_comes_near_its_targets(spark):
    rnd = random.Random(1)
    data = [(i, " ".join(["w"] * rnd.randint(1, 300)), f"s{i % 7}" if i % 3 else "hot") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"))
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("mix_size")).alias("taken"), F.first("target").alias("target")).collect():
        assert r["taken"] == pytest.approx(r["target"], rel=0.005)


def test_mixing_in_finer_bins_takes_the_same(spark, monkeypatch):
    """Sorting the whole bin in which a budget ends, as a single finer bin does, takes the same documents; so does a
    plain running sum over all of them."""
    rnd = random.Random(5)
    data = [(i % 3900, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "b", "c", None])) for i in range(4000)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    taken = []
    for finer in (1, 64, 4096):
        monkeypatch.setattr(mixing, "FINER", finer)
        got = mixing.mix(df).select("doc_id", "source", "mix_size", "copies").collect()
        taken.append(sorted((r[0], str(r[1]), r[2], r[3]) for r in got))
    assert taken[0] == taken[1] == taken[2]
    keys = mixing.keyed(df).join(mixing.targets(mixing.keyed(df)).withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    want = []
    for source in ("a", "b", "c", None):
        rows = sorted((r["mix_key"], r["doc_id"], r["mix_size"], r["source_size"], r["target"]) for r in keys.where(F.col("source").eqNullSafe(F.lit(source))).collect())
        full = min(3, int(rows[0][4] / rows[0][3] + 1e-12))
        left, chosen = 0.0 if full == 3 else rows[0][4] - full * rows[0][3], set()
        for i in range(3):
            used = 0
            for key in sorted({r[:2] for r in rows}):
                here = [j for j, r in enumerate(rows) if r[:2] == key and j not in chosen and r[2] > 0 and (i == 0 or r[2] <= left)]
                size = sum(rows[j][2] for j in here)
                if here and (used + size if i < 2 else used + size - rows[here[-1]][2] / 2) > left:
                    break
                chosen |= set(here)
                used += size
            left -= used
        want += [(r[1], str(source), r[2], full * (r[2] > 0) + (j in chosen)) for j, r in enumerate(rows)]
    assert sorted(want) == taken[0]


def test_bpe_equals_the_library(docs, none, rows):
    library = Tokenizer.from_file(PATH)
    got = by_id(bpe.encode_decode(docs, PATH, 50), "ids", "decoded")
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[doc_id] == (ids, library.decode(ids, skip_special_tokens=False)), doc_id
    assert bpe.encode_decode(none, PATH).count() == 0


def test_bpe_random_strings():
    library, coder, rnd = Tokenizer.from_file(PATH), bpe.Coder(PATH), random.Random(2)
    alphabet = "aab'Sstθσς ΣİiÍ̈é12 .,!<|>endoftext|\x1c\x85\xa0 x͸Ᲊ" + chr(0x10FFF)
    for _ in range(3000):
        s = "".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40)))
        assert np.frombuffer(coder.encode([s.encode()])[0], "<i4").tolist() == library.encode(s, add_special_tokens=False).ids, s
    long = "ab" * 3000
    assert np.frombuffer(coder.encode([long.encode()])[0], "<i4").tolist() == library.encode(long, add_special_tokens=False).ids


def test_lexicon_shares_suffixes(tmp_path):
    words_ = {f"{a}{b}ing".encode(): [i, j] for i, a in enumerate("abcdefgh") for j, b in enumerate("klmnop")} | {b"a": [7], "é".encode(): []}
    states = bpe.compile_lexicon(words_, f"{tmp_path}/l")
    lexicon = bpe.Lexicon(f"{tmp_path}/l")
    assert states < 12 and all(lexicon.get(w) == ids for w, ids in words_.items())
    assert all(lexicon.get(w) is None for w in (b"", b"ak", b"akin", b"akings", b"zz"))
    assert bpe.compile_lexicon({}, f"{tmp_path}/e") == 1 and bpe.Lexicon(f"{tmp_path}/e").get(b"a") is None


def test_bpe_merges_new_words_together(monkeypatch, tmp_path):
    """Words new to a batch are looked up and merged as arrays; one by one they took most of the encoder's time."""
    library, rnd = Tokenizer.from_file(PATH), random.Random(3)
    made = ["".join(rnd.choice("abdeinorstuéßñ") for _ in range(rnd.randint(1, 30))) for _ in range(2000)]
    texts = [None, "", " \n", *(" ".join(f"{rnd.choice(made)}{rnd.choice(['', '.', '!?', '7', '<|endoftext|>'])}" for _ in range(80)) for _ in range(100)), "x" * 500]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    merger = bpe.Merger(PATH)
    bpe.compile_lexicon({w.encode(): merger.word(w.encode()) for w in made[:200]}, f"{tmp_path}/l")
    one = bpe.Merger.word
    monkeypatch.setattr(bpe.Merger, "word", lambda self, w: one(self, w) if len(w) > 48 else pytest.fail(f"{w} was merged alone"))
    coders = bpe.Coder(PATH), bpe.Coder(PATH, f"{tmp_path}/l"), bpe.Coder(PATH, room=(1, 1)), bpe.Coder(PATH, library=True)
    for coder in coders:
        for _ in range(2):
            for at in range(0, len(texts), 20):
                got = coder.encode([(t or "").encode() for t in texts[at : at + 20]])
                assert [np.frombuffer(x, "<i4").tolist() for x in got] == want[at : at + 20]
        array = pa.array([t and t.encode() for t in texts], pa.binary())[1:90]
        ids, ends = coder.encode_array(array)
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == want[1:90]
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
        assert coder.decode(lists).to_pylist() == [library.decode(x, skip_special_tokens=False) for x in want[1:90]]
        assert coder.encode([]) == [] and coder.encode([b""]) == [b""]
    assert max(map(len, coders[0].words.keys() - coders[0].merger.added.values())) <= bpe.LONG


def test_token_files(spark, docs, none, rows):
    library, out = Tokenizer.from_file(PATH), fresh_dir(spark, "test-ids")
    token_ids.write_token_files(docs, out, PATH, 1)
    got = sorted(((r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in token_ids.read_token_files(spark, out).collect()), key=lambda r: r[1])
    start = 0
    for (doc_id, text, *_), row in zip(sorted(rows, key=lambda r: r[0]), got, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 1]
        assert row == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    empty = fresh_dir(spark, "test-ids")
    token_ids.write_token_files(none, empty, PATH, 1)
    assert token_ids.read_token_files(spark, empty).count() == 0


def test_warc(spark):
    html = ["<a>", None, "", "<a>", "é" * 1000, "<a>", "x" * 200_000, ""]
    data = [(i, None if i == 2 else f"http://h/{i} \n", h, i) for i, h in enumerate(html)] + [(6, "http://h/6 \n", "x" * 200_000, 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string, shard long")
    out = fresh_dir(spark, "test-warc")
    manifest = warc.write_warc(pages, out, file_bytes=500)
    assert manifest.count() > 1 and manifest.agg(F.sum("records")).first()[0] == 9
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] if r["refers_to"] is not None else -1) for r in warc.read_warc(spark, out).collect())
    last = {h or "": i for i, h in enumerate(html)}
    want = []
    for i, h in enumerate(html):
        raw, at = (h or "").encode(), last[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if at == i else "revisit", -1 if at == i else at))
    want.append((*want[6][:3], "revisit", 6))  # the row that repeats an id
    assert got == sorted(want)
    again = fresh_dir(spark, "test-warc")
    assert [r["sha1"] for r in warc.write_warc(pages.repartition(5), again, file_bytes=500).orderBy("file").collect()] == [r["sha1"] for r in manifest.orderBy("file").collect()]
    empty = fresh_dir(spark, "test-warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0


def test_warc_rolls_files_at_its_defaults(spark, monkeypatch):
    monkeypatch.setattr(warc, "SHARD_BYTES", 1 << 20)
    rnd = random.Random(6)
    data = [(i, f"http://h/{i}", "".join(rnd.choice("abcdefgh <>") for _ in range(20_000))) for i in range(150)] + [(2**60, "http://far", "x")]
    out = fresh_dir(spark, "test-warc")
    files = warc.write_warc(spark.createDataFrame(data, "page_id long, url string, html string"), out).collect()
    shards = Counter(r["shard"] for r in files)
    assert len(shards) >= 3 and max(shards.values()) > 2 and max(r["bytes"] for r in files) < 1 << 20
    assert warc.read_warc(spark, out).count() == 151


def test_range_shards_of_ids_that_lie_far_out(spark):
    df = spark.createDataFrame([(i, 200_000) for i in range(400)] + [(2**63 - 1, 5), (-(2**63), 7), (None, 9)], "id long, s long")
    shard, n, target = range_shards(df, "id", F.col("s"), 16 << 20)
    assert target == 16 << 20
    rows = df.select("id", "s", shard.alias("shard")).collect()
    sums = Counter()
    for r in rows:
        sums[r["shard"]] += r["s"]
    assert n == len(sums) == 5 and max(sums.values()) <= 17 << 20
    known = sorted((r["id"], r["shard"]) for r in rows if r["id"] is not None)
    assert [s for _, s in known] == sorted(s for _, s in known)
    # few shards at most grow instead
    shard, n, target = range_shards(df, "id", F.col("s"), 1 << 20, most=3)
    sums = {r["shard"]: r["s"] for r in df.groupBy(shard.alias("shard")).agg(F.sum("s").alias("s")).collect()}
    assert target == 400 * 200_000 // 3 + 7 and n == len(sums) <= 4 and max(sums.values()) <= target + 200_000


def brute_repeats(items):
    seen, out = set(), {}
    for doc_id, text in sorted(items):
        w, gone = words(text), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                gone |= set(range(i, i + 20))
            seen.add(g)
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc_id] = (len(w), len(gone), kept)
    return out


def test_substrings(docs, none, rows):
    assert by_id(substrings.remove_repeats(docs), "n_words", "n_removed", "kept") == brute_repeats({(r[0], r[1] or "") for r in rows})
    assert substrings.remove_repeats(none).count() == 0


def test_substrings_random(spark, monkeypatch):
    rnd = random.Random(9)
    parts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randint(5, 40))) for _ in range(6)]
    data = [(i, " ".join(rnd.choice(parts) for _ in range(rnd.randint(1, 5)))) for i in range(60)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for hot in (substrings.HOT, 2):
        monkeypatch.setattr(substrings, "HOT", hot)
        assert by_id(substrings.remove_repeats(df), "n_words", "n_removed", "kept") == brute_repeats(data)


def test_substrings_texts_of_one_id(spark):
    rnd = random.Random(11)
    make = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    a, b, c = make(30), make(25), make(22)
    data = [(None, f"{a} {b} {make(60)}"), (None, b), (None, f"{make(5)} {a}"), (7, f"{c} {make(90)}"), (7, f"{make(3)} {c}"), (7, c), (7, c)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.remove_repeats(df).collect())
    twin = {r["text"]: r["h"] for r in df.select("text", F.xxhash64("text", F.col("doc_id").isNull()).alias("h")).collect()}
    seen, want = set(), {}
    for doc_id, text in sorted(set(data), key=lambda d: (d[0] is None, d[0] or 0, twin[d[1]])):
        w, gone = words(text), set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            gone |= set(range(i, i + 20)) if g in seen else set()
            seen.add(g)
        want[doc_id, text] = (doc_id, len(w), len(gone))
    assert got == Counter(want[d] for d in data)
    assert sum(n for _, _, n in want.values()) > 0


def test_substrings_come_through_the_index(spark, monkeypatch):
    rnd = random.Random(12)
    make = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    passage, whole = make(50), make(120)
    data = [(i, f"{make(9)} {passage} {make(9)}") for i in range(30)] + [(100 + i, whole) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    for hot in (substrings.HOT, 5):  # the passage's first and last windows stand in 30 contents
        monkeypatch.setattr(substrings, "HOT", hot)
        assert by_id(substrings.remove_repeats(df), "n_words", "n_removed", "kept") == brute_repeats(data)
    blind = lambda self, stream, at, length, least: (np.zeros(len(at), np.int64),) * 3
    monkeypatch.setattr(fm_index.FMIndex, "search", blind)
    text = [(i, t, 0, "".join(t)) for i, t in data[:2]]
    assert len(text) == 2
    import pyarrow as pa

    heads = pa.table({"mini": [1, 1], "digest": [1, 2], "copied": [True, True], "key": [0, 1], "twin": [0, 0], "start": pa.array([0, 0], pa.int32()), "words": [passage.encode()] * 2})
    assert substrings._search_shard(heads).num_rows == 0
    monkeypatch.undo()
    assert substrings._search_shard(heads).num_rows == 3  # both heads are held, the second's windows are repeats


def test_fm_index():
    rnd = np.random.default_rng(1)
    text = np.append(rnd.integers(1, 4, 500), 0)  # 0 ends the text
    index = fm_index.FMIndex(text, 4, 512)
    matched, low, high = index.search(text, np.arange(490), np.full(490, 8), 2)
    for i in range(490):
        places = [j for j in range(493) if (text[j : j + 8] == text[i : i + 8]).all()]
        if len(places) > 1:
            assert matched[i] == 8 and sorted(index.locate(np.arange(low[i], high[i]))) == places
        else:
            assert matched[i] < 8
    matched, low, high = index.search(text, np.arange(480), np.arange(480) % 20, 1)
    assert (matched == np.arange(480) % 20).all()
    assert sorted(index.locate(np.arange(501))) == list(range(501))


def test_ann(spark):
    rnd = np.random.default_rng(4)
    v = rnd.normal(size=(3000, 20))
    v[100:900] = v[7]  # a hot vector
    data = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    odd = [(9001, None), (9002, [0.0] * 20), (9003, [float("nan")] * 20), (9004, [None] * 20), (9005, [1.0]), (9006, [float("inf")] * 20)]
    df = spark.createDataFrame(data + odd + data[:3], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.search(df, F.col("id") % 60 == 0, 10).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hits = total = 0
    for q in range(0, 3000, 60):
        s = v @ v[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:10]
        assert len(got[q]) == 10 and all(score == pytest.approx(s[i]) for i, score in got[q])
        hits, total = hits + len({i for i, _ in got[q]} & set(want)), total + 10
    assert hits / total >= 0.95
    assert [i for i, _ in got[120]] == [7, *[i for i in range(100, 110) if i != 120]][:10] or np.isclose(v[7] @ v[120], v[120] @ v[120])
    assert ann.search(df.limit(0), F.col("id") % 60 == 0, 10).count() == 0
    many = ann.search(df, F.col("id") == 60, 300).orderBy("rank").collect()
    assert [r["rank"] for r in many] == list(range(1, 301))
    few = spark.createDataFrame(data[:5], df.schema)
    assert ann.search(few, F.col("id") == 0, 10).count() == 4


def test_stupid_backoff(docs, none, rows):
    split = [words("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "")) for r in rows]
    for order in (2, 3):
        got = sorted((r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in stupid_backoff.score(docs, order).collect())
        every = Counter(tuple(w[i : i + k]) for w in split for k in range(1, order + 1) for i in range(len(w) - k + 1))
        want, n = [], sum(map(len, split))
        for r, w in zip(rows, split):
            own = Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
            c = lambda g: every[g] - own[g]  # noqa: B023, E731
            total = 0.0
            for i in range(len(w)):
                s, factor = None, 1.0
                for k in range(min(order, i + 1), 0, -1):
                    g = tuple(w[i - k + 1 : i + 1])
                    if c(g) > 0:
                        s = factor * c(g) / (c(g[:-1]) if k > 1 else n - len(w))
                        break
                    factor *= 0.4 if k > 1 else 1.0
                total += math.log(s if s is not None else factor / (n - len(w) + 1))
            want.append((r[0], len(w), round(total, 6)))
        assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
        assert all(a[2] == pytest.approx(b[2], abs=1e-5) for a, b in zip(got, sorted(want)))
    assert stupid_backoff.score(none).count() == 0


def test_backoff_blocks_round_trip():
    rng = np.random.default_rng(5)
    top = np.uint64(2**64 - 1)
    for hashes in ([0], [top], [0, top], range(300), rng.integers(0, 2**64, 5000, np.uint64), rng.integers(0, 70_000, 5000, np.uint64)):
        distinct = np.unique(np.array(hashes, np.uint64))
        assert (stupid_backoff._unpack(stupid_backoff._pack(distinct)) == distinct).all()
    for counts in ([1], [255], [256], [1, 2**32 - 1], [1] * 4):
        assert (stupid_backoff._unpack_counts(stupid_backoff._pack_counts(np.array(counts)), len(counts)) == counts).all()


@pytest.mark.parametrize("name", ["op8_stupid_backoff", "op8_stupid_backoff_bigram"])
def test_backoff_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(queries.ORACLE_SQL[name]).fetchall()}
    got = by_id(queries.QUERIES[name](spark, "/root/testdata/sf0.001"), "n_words", "log_score", "mean_log_score")
    assert got.keys() == want.keys()
    assert all(g == pytest.approx(want[k], abs=2e-4) for k, g in got.items())


def test_backoff_orders_differ(spark):
    three, two = (by_id(queries.QUERIES[f"op8_stupid_backoff{name}"](spark, "/root/testdata/sf0.001"), "log_score") for name in ("", "_bigram"))
    assert any(abs(two[k][0] - g[0]) > 0.01 for k, g in three.items())


def test_pipeline_stages(spark, docs, none):
    for table in (docs, none):
        for name, stage in (("quality", stages.quality), ("near_dedup", stages.near_dedup), ("pii", stages.mask_pii), ("mixing", stages.mix)):
            out = stage(spark, table, "")
            assert out.columns == docs.columns, name
            out.count()
        assert stages.encode(spark, table, "").columns == ["doc_id", "n_tokens", "ids"]
    kept = [r["doc_id"] for r in stages.near_dedup(spark, docs, "").collect()]
    assert len(kept) == len(set(kept)) and 8 in kept and 9 not in kept


def test_ann_finds_neighbours_that_codes_cannot_tell_apart(spark):
    """Tight clusters of more vectors than were ever reranked by number, and norms of very unlike size."""
    rnd = np.random.default_rng(11)
    noise = rnd.normal(size=(6000, 16))
    for x in (rnd.normal(size=(4, 16))[np.arange(6000) % 4] + 0.01 * noise, noise * np.exp(2 * rnd.normal(size=(6000, 1)))):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
        rows = ann.search(df, F.col("id") % 200 == 0, 20).collect()
        score = x[::200] @ x.T
        score[np.arange(30), np.arange(0, 6000, 200)] = -np.inf
        best = {(i * 200, int(j)) for i, s in enumerate(score) for j in np.argsort(-s)[:20]}
        assert len(rows) == 600 and len(best & {(r["query_id"], r["vec_id"]) for r in rows}) >= 594
