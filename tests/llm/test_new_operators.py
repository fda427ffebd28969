"""Resharding, Merkle manifests and phrases against plain Python on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievework.llm import merkle, phrases, queries, resharding
from sievework.llm.shared import fresh_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("group", "i", "n", "h", "shard", "block", "at", "size_", "row", "piece", "m", "slot")


def odd_rows() -> list[tuple]:
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice("Alpha beta. gamma, delta".split()) for _ in range(rnd.randrange(0, 60))), rnd.choice(["en", "fr", "é", None]), rnd.choice(["a", None]), rnd.choice([k, None])) for k in range(120)]
    rows += [(k, "one Two three four five six", "en", "a", 5) for k in range(200, 240)]  # copies
    rows += [(5, rows[5][1], rows[5][2], rows[5][3], rows[5][4])] * 3 + [(6, "other text", "en", "a", 1)]  # repeated ids
    rows += [(None, "No id", "en", "a", 1), (None, None, None, None, None), (300, None, "en", "a", 1), (301, "", "zz", "a", 0), (302, " \t\n", "en", "a", 3)]
    rows.append((303, "Long " * 20_000 + ".", "fr", "b", 100_001))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(5)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(7))
    return df


def written(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_flow_is_cheapest():
    rnd = random.Random(2)
    for _ in range(60):
        n, m = rnd.randrange(1, 5), rnd.randrange(1, 5)
        supply = [rnd.randrange(0, 9) for _ in range(n)]
        cuts = sorted(rnd.randrange(0, sum(supply) + 1) for _ in range(m - 1))
        demand = [b - a for a, b in zip([0, *cuts], [*cuts, sum(supply)])]
        cost = [[int(i != j) for j in range(m)] for i in range(n)]
        flow = resharding.cheapest_flow(supply, demand, cost)
        assert [sum(f for (i, _), f in flow.items() if i == k) for k in range(n)] == supply
        assert [sum(f for (_, j), f in flow.items() if j == k) for k in range(m)] == demand and min(flow.values(), default=1) > 0
        stays = sum(min(supply[k], demand[k]) for k in range(min(n, m)))  # the most that can stay
        assert sum(f * cost[i][j] for (i, j), f in flow.items()) == sum(supply) - stays
    # by hand: 3 units of the first source must take the dearer way
    assert resharding.cheapest_flow([5, 2], [4, 3], [[1, 4], [2, 9]]) == {(0, 0): 2, (0, 1): 3, (1, 0): 2}
    with pytest.raises(ValueError):
        resharding.cheapest_flow([1], [2], [[0]])


def test_resharding(spark, odd, tmp_path):
    got = queries.QUERIES["op11_resharding"](spark, written(spark, odd, tmp_path)).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len(text(t)) + 1, zlib.crc32(text(t))) for d, t, *_ in odd_rows())
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_resharding_is_even_moves_little_and_keeps_rows(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', CAST(10 + id * 7919 % 500 AS INT))").alias("text"), F.lit(1).alias("shard"))
    out = fresh_dir(spark, "layout-test")
    resharding.write_layout(docs, out, F.pmod(F.xxhash64("doc_id"), F.lit(3)))
    flow = resharding.reshard(spark, out, 4)
    rows = resharding.read_layout(spark, out)
    assert rows.select("row.*").exceptAll(docs).isEmpty() and rows.count() == 4000
    sizes = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("size").alias("n")).collect()}
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) - min(sizes.values()) < 1000
    before = resharding.read_layout(spark, out, 0)
    moved = before.select("shard", "row.doc_id", "size").join(rows.select(F.col("shard").alias("now"), "row.doc_id"), "doc_id").where("shard <> now").agg(F.sum("size")).first()[0]
    assert abs(moved - sum(n for (i, j), n in flow.items() if i != j)) < 4000
    kept = spark.read.parquet(f"{out}/manifest-1").where("generation = 0").count()
    assert kept > 0.5 * spark.read.parquet(f"{out}/manifest-0").count()
    resharding.reshard(spark, out, 4, generation=2)  # nothing left to move but what rows' sizes leave
    assert resharding.read_layout(spark, out, 2).count() == 4000


def test_resharding_of_nothing(spark, tmp_path):
    assert queries.QUERIES["op11_resharding"](spark, written(spark, spark.createDataFrame([], SCHEMA), tmp_path)).collect() == []


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over digests, and for each of them what stands left and right of it level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, at):
            run = nodes[k // 8 * 8 : k // 8 * 8 + 8]
            path.append(("".join(run[: k % 8]), "".join(run[k % 8 + 1 :])))
        nodes = [sha(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        at = [k // 8 for k in at]
    return nodes[0], paths


def test_merkle(spark, odd, tmp_path):
    got = queries.QUERIES["op12_merkle"](spark, written(spark, odd, tmp_path)).collect()
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    low = lambda t: t and re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = defaultdict(list)
    for d, t, lang, source, n in odd_rows():
        leaf = sha(*map(told, (d, source, lang, n, t)))
        bad = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups[lang].append((d is not None, d or 0, leaf, sha(*map(told, (d, source, lang, n, low(t)))) if bad else leaf, d))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([x[2] for x in sorted(groups[g])]) for g in order}
    root, tops = climb([trees[g][0] for g in order])
    want = []
    for g, top in zip(order, tops):
        for (_, _, leaf, changed, d), path in zip(sorted(groups[g]), trees[g][1]):
            proof, h = path + top, changed
            for left, right in proof:
                h = sha(left, h, right)
            want.append((d, leaf, trees[g][0], root, sha(*(x for s in proof for x in s)), h, h == root))
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    assert Counter(tuple(r[c] for c in names) for r in got) == Counter(want)
    assert 0 < sum(not r["verified"] for r in got) < len(got)


def test_merkle_of_little(spark):
    one = spark.createDataFrame([(1, "A", "en", "s", 1)], SCHEMA)
    r = merkle.manifest(one).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == []
    assert merkle.manifest(one.limit(0)).collect() == []


def best_phrases(rows: list[tuple], least: int, top: int) -> list[tuple]:
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    candidates = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    outer = Counter()
    for (lang, w), a in candidates.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                outer[lang, w[i : i + k]] = max(outer[lang, w[i : i + k]], a)
    out = defaultdict(list)
    for (lang, w), a in candidates.items():
        if 100 * outer[lang, w] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return [(g, i + 1, p.decode(), -a, lo, r, n[g], -s) for g in out for i, (s, a, p, lo, r) in enumerate(sorted(out[g])[:top])]


def test_phrases(spark, odd, monkeypatch):
    names = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    for least, top, flush in ((3, 2000, 1 << 20), (2, 10, 50)):
        monkeypatch.setattr(phrases, "FLUSH_WORDS", flush)
        got = phrases.collocations(odd, top=top, least=least).collect()
        assert sorted(tuple(r[c] for c in names) for r in got) == sorted(best_phrases(odd_rows(), least, top))
    assert phrases.collocations(odd.limit(0)).collect() == []


def test_million_words(spark, tmp_path):
    """One text of a million words without punctuation."""
    words = " ".join(f"w{k % 1009}" for k in range(1_000_000))
    docs = spark.createDataFrame([(1, words, "en", "a", len(words)), (2, "x", "en", "a", 1)], SCHEMA)
    path = written(spark, docs, tmp_path)
    assert {r["doc_id"]: r["size"] for r in queries.QUERIES["op11_resharding"](spark, path).collect()} == {1: len(words) + 1, 2: 2}
    assert len(queries.QUERIES["op12_merkle"](spark, path).collect()) == 2
    got = queries.QUERIES["op13_phrases"](spark, path).collect()
    assert len(got) == 1009 and got[0]["n"] == 1_000_001 and {r["a"] for r in got} <= {990, 991, 992}
