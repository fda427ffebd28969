"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import ann, bpe, merkle, minhash, mixing, phrases, pii, quality_rules, resharding, stupid_backoff, substrings, token_ids, warc
from sievework.llm.shared import fresh_dir

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op9_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = fresh_dir(spark, "token-ids")
    token_ids.write_token_files(docs, out, TOKENIZER, end_id=1)
    read = token_ids.read_token_files(spark, out)
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    out = fresh_dir(spark, "warc")
    warc.write_warc(spark.read.parquet(f"{sf}/pages.parquet"), out)
    return warc.read_warc(spark, out).drop("payload", "url")


ORACLE_SQL["op3_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, html, array_to_string(list_transform(range(40),
        lambda j: right(bin(16 + strpos('0123456789abcdef', substr(h, j::INT + 1, 1)) - 1), 4)), '') AS bits FROM p)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    (16 * substr(bits, i::INT * 5 + 1, 1)::INT + 8 * substr(bits, i::INT * 5 + 2, 1)::INT + 4 * substr(bits, i::INT * 5 + 3, 1)::INT
     + 2 * substr(bits, i::INT * 5 + 4, 1)::INT + substr(bits, i::INT * 5 + 5, 1)::INT), 1)), '') AS payload_digest,
  CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY html)"""


@query
def op7_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode_decode(spark.read.parquet(f"{sf}/documents.parquet"), TOKENIZER)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_mixing(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(spark.read.parquet(f"{sf}/documents.parquet"))
    taken = (F.col("copies") * F.col("mix_size")).alias("taken")
    return mixed.select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", taken)


@query
def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality(spark.read.parquet(f"{sf}/documents.parquet")).drop("host", "text_id", "depleted")


ORACLE_SQL["op2_quality_rules"] = r"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text, md5(text) AS text_id,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT *, len(w) AS n_words, list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM c)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest(range(3)) AS k) GROUP BY doc_id),
x AS (SELECT host, text_id, doc_id, regexp_replace(regexp_replace(trim(lower(unnest(l)), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g') AS line FROM c),
often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT doc_id) AS n FROM x WHERE line <> '' GROUP BY ALL)
    JOIN (SELECT host, count(DISTINCT doc_id) AS docs FROM x WHERE line <> '' GROUP BY ALL) USING (host) WHERE n > 20 AND n > 0.01 * docs),
lost AS (SELECT doc_id, sum(len(string_split(line, ' '))) AS n FROM x JOIN often USING (host, line) GROUP BY doc_id),
o AS (SELECT doc_id, n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
    len(full_lines) - len(list_distinct(full_lines)) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
    FROM c LEFT JOIN rw USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost <= 0.5 * n_words AS kept FROM o"""


@query
def op10_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"), n=4, percent=80)


ORACLE_SQL["op10_minhash"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i : i + 3], ' ') END AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
    JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT documents.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, documents.doc_id = c.component_id AS kept
FROM documents LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)"""


@query
def op5_pii(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find(spark.read.parquet(f"{sf}/documents.parquet"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{pii.KINDS[k]}")
    return found.select("doc_id", *map(count, range(4)), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


@query
def op4_substrings(spark: SparkSession, sf: str) -> DataFrame:
    left = substrings.remove_repeats(spark.read.parquet(f"{sf}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL["op4_substrings"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
x AS (SELECT doc_id, list(DISTINCT i + k) AS gone FROM r, (SELECT unnest(range(20)) AS k) GROUP BY doc_id),
k AS (SELECT doc_id, list(w ORDER BY i) AS kept FROM (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM d) u
    ANTI JOIN (SELECT DISTINCT doc_id, i + k AS i FROM r, (SELECT unnest(range(20)) AS k)) v USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)"""


@query
def op1_ann(spark: SparkSession, sf: str) -> DataFrame:
    return ann.search(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 20 == 0, k=20)


@query
def op8_stupid_backoff(spark: SparkSession, sf: str) -> DataFrame:
    scored = stupid_backoff.score(spark.read.parquet(f"{sf}/documents.parquet"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL["op8_stupid_backoff"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, i, w[i] AS u, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS q
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
a AS (SELECT *, sum(1) OVER () - n AS words_left, count(*) OVER (PARTITION BY u) - count(*) OVER (PARTITION BY u, doc_id) AS c1,
  count(*) OVER (PARTITION BY p, u) - count(*) OVER (PARTITION BY p, u, doc_id) AS c2,
  count(*) OVER (PARTITION BY q, p, u) - count(*) OVER (PARTITION BY q, p, u, doc_id) AS c3 FROM t),
b AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS before, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS before2 FROM a),
s AS (SELECT doc_id, ln(CASE WHEN i > 2 AND c3 > 0 THEN c3 / before2 ELSE (CASE WHEN i > 2 THEN 0.4::DOUBLE ELSE 1 END) *
    CASE WHEN i > 1 AND c2 > 0 THEN c2 / before
    ELSE (CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END) * CASE WHEN c1 > 0 THEN c1 / words_left ELSE 1 / (words_left + 1) END END END) AS l FROM b)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(l), 0), 4) AS log_score,
  CASE WHEN len(w) > 0 THEN round(sum(l) / len(w), 6) END AS mean_log_score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.w"""


@query
def op8_stupid_backoff_bigram(spark: SparkSession, sf: str) -> DataFrame:
    scored = stupid_backoff.score(spark.read.parquet(f"{sf}/documents.parquet"), order=2)
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


ORACLE_SQL["op8_stupid_backoff_bigram"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS n, i, w[i] AS u, CASE WHEN i > 1 THEN w[i - 1] END AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
a AS (SELECT *, sum(1) OVER () - n AS words_left, count(*) OVER (PARTITION BY u) - count(*) OVER (PARTITION BY u, doc_id) AS c1,
  count(*) OVER (PARTITION BY p, u) - count(*) OVER (PARTITION BY p, u, doc_id) AS c2 FROM t),
b AS (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM a),
s AS (SELECT doc_id, ln(CASE WHEN i > 1 AND c2 > 0 THEN c2 / before
    ELSE (CASE WHEN i > 1 THEN 0.4::DOUBLE ELSE 1 END) * CASE WHEN c1 > 0 THEN c1 / words_left ELSE 1 / (words_left + 1) END END) AS l FROM b)
SELECT d.doc_id, len(w) AS n_words, round(coalesce(sum(l), 0), 4) AS log_score,
  CASE WHEN len(w) > 0 THEN round(sum(l) / len(w), 6) END AS mean_log_score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, d.w"""


#: Shards of the layout that op11 takes documents from, by a hash of doc_id, and of the one it makes.
OLD_SHARDS, NEW_SHARDS = 6, 8


@query
def op11_resharding(spark: SparkSession, sf: str) -> DataFrame:
    """From six shards, uneven as hashes make them, to eight of equal bytes."""
    out = fresh_dir(spark, "layout")
    resharding.write_layout(spark.read.parquet(f"{sf}/documents.parquet"), out, F.pmod(F.xxhash64("doc_id"), F.lit(OLD_SHARDS)))
    resharding.reshard(spark, out, NEW_SHARDS)
    read = resharding.read_layout(spark, out)
    crc = F.crc32(F.coalesce("row.text", F.lit(""))).alias("text_crc32")
    return read.select("row.doc_id", "size", crc, F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = merkle.manifest(spark.read.parquet(f"{sf}/documents.parquet"), tampered)
    siblings = F.array_join(F.transform("proof", lambda s: F.concat(s["left"], s["right"])), "")
    rows = rows.withColumn("folded_root", merkle.folded(F.col("tampered_leaf"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(spark.read.parquet(f"{sf}/documents.parquet"))


ORACLE_SQL["op13_phrases"] = r"""
WITH p AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
s AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
o AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k),
f AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS phrase, k, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
i AS (SELECT lang, array_to_string(w[b : b + m - 1], ' ') AS phrase, max(a) AS outside FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS b
    FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k) GROUP BY ALL),
t AS (SELECT c.* FROM c LEFT JOIN i USING (lang, phrase) WHERE outside IS NULL OR 100 * outside < 80 * a),
x AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS one, array_to_string(w[j + 1 :], ' ') AS two FROM (SELECT *, unnest(range(1, k)) AS j FROM t)),
y AS (SELECT x.lang, x.phrase, a, j, g.f AS l, h.f AS r, (2000000 * a::HUGEINT) // (g.f + h.f) AS score
    FROM x JOIN f g ON g.lang = x.lang AND g.phrase = one JOIN f h ON h.lang = x.lang AND h.phrase = two),
z AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM q JOIN s USING (lang) WHERE rank <= 2000"""


# crc32 of a document's number, bit by bit, as DuckDB has no such function
ORACLE_SQL["op12_merkle"] = r"""
WITH RECURSIVE f AS (SELECT doc_id, lang, text, row_number() OVER () AS row_, concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-'),
    coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-')) AS head FROM documents),
y AS (SELECT row_, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) AS crc FROM f),
x AS (SELECT doc_id, coalesce('=' || lang, '') AS g, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, CASE WHEN crc % 3 = 0
    THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS changed FROM f JOIN y USING (row_)),
b AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM x),
t AS (SELECT g, 0 AS k, i, n, leaf AS h FROM b UNION ALL
  SELECT g, k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 8, n),
r AS (SELECT g, h, max(k) OVER (PARTITION BY g) AS depth, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS m FROM t WHERE n = 1),
u AS (SELECT 0 AS k, j AS i, m AS n, h FROM r UNION ALL SELECT k + 1, i // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 8, n),
a AS (SELECT g, k, i, n, h, i // 8 AS run FROM t WHERE n > 1 UNION ALL SELECT r.g, depth + u.k, u.i, u.n, u.h, u.i // 8 FROM u, r WHERE u.n > 1 AND u.i // 8 = (r.j // (8 ** u.k)::BIGINT) // 8),
s AS (SELECT a.g, a.k, a.i, coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i < a.i), '') AS l, coalesce(string_agg(z.h, '' ORDER BY z.i) FILTER (z.i > a.i), '') AS o
  FROM a JOIN a z ON z.g = a.g AND z.k = a.k AND z.run = a.run GROUP BY a.g, a.k, a.i),
w AS (SELECT b.g, b.i, b.doc_id, leaf, h AS subroot, j, depth, 0 AS k, '' AS proof, coalesce(changed, leaf) AS c FROM b JOIN r USING (g) UNION ALL
  SELECT w.g, w.i, doc_id, leaf, subroot, j, depth, w.k + 1, proof || l || o, sha256(l || c || o) FROM w JOIN s ON s.g = w.g AND s.k = w.k
    AND s.i = CASE WHEN w.k < depth THEN w.i // (8 ** w.k)::BIGINT ELSE j // (8 ** (w.k - depth))::BIGINT END),
e AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY g, i ORDER BY k DESC) = 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM u WHERE n = 1) AS root, sha256(proof) AS proof_sha256, c AS folded_root, c = (SELECT h FROM u WHERE n = 1) AS verified FROM e"""
