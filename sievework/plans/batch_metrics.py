"""Queries: metrics, filters, joins and reshaping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.operators import advantages as W
from sievework.operators import batch as B
from sievework.operators import filters as FI
from sievework.operators import losses as L
from sievework.operators import metrics as M
from sievework.plans.standins import SCORED, TOKENS, scored, table, tokens

QUERIES, ORACLE_SQL = {}, {}
R6 = lambda c, name: F.round(c, 6).alias(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {TOKENS}, s AS (SELECT uid, sum(reward) AS score, sum(mask) AS len, count(*) AS n FROM k GROUP BY uid)
SELECT round((SELECT avg(score) FROM s), 5) AS score_mean, round((SELECT max(score) FROM s), 5) AS score_max, round((SELECT min(score) FROM s), 5) AS score_min, round(avg(value), 6) AS value_mean,
  round(1 - var_samp(reward - value) / (var_samp(reward) + 1e-5), 6) AS explained, (SELECT avg(len) FROM s) AS length_mean, round((SELECT avg((len >= 45)::INT) FROM s), 6) AS clip_ratio FROM k WHERE mask = 1""")
def a2_a3_data_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Sequence scores and lengths, and masked token statistics; the padded width (45) is a parameter."""
    rows = tokens(spark, sf)
    seq = rows.groupBy("uid").agg(F.sum("reward").alias("score"), F.sum("mask").alias("len"))
    per = seq.agg(F.round(F.avg("score"), 5).alias("score_mean"), F.round(F.max("score"), 5).alias("score_max"), F.round(F.min("score"), 5).alias("score_min"), F.avg("len").alias("length_mean"), R6(F.avg((F.col("len") >= 45).cast("int")), "clip_ratio"))
    live = rows.where("mask = 1").agg(R6(F.avg("value"), "value_mean"), R6(M.explained_variance(F.col("reward"), F.col("value")), "explained"))
    return per.crossJoin(F.broadcast(live))


@query("""WITH t AS (SELECT event_type AS name, sum(value) AS seconds, count(*) AS tokens FROM events GROUP BY 1) SELECT name, round(seconds, 4) AS seconds, round(1000 * seconds / tokens, 4) AS ms_per_token, round(tokens / (seconds * 8), 6) AS throughput FROM t""")
def a4_a5_timing(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "events").groupBy(F.col("event_type").alias("name")).agg(F.sum("value").alias("seconds"), F.count("*").alias("tokens"))
    s, n = F.col("seconds"), F.col("tokens")
    return t.select("name", F.round(s, 4).alias("seconds"), F.round(1000 * s / n, 4).alias("ms_per_token"), R6(n / (s * 8), "throughput"))


_LONG = """m AS (SELECT event_type || CASE user_id % 3 WHEN 0 THEN '/max' WHEN 1 THEN '/minmax_diff' ELSE '/mean' END AS metric, value FROM events UNION ALL SELECT event_type || '/min' AS metric, value FROM events WHERE user_id % 5 = 0)"""


@query(f"WITH {_LONG} SELECT metric, round(CASE WHEN contains(metric, 'max') THEN max(value) WHEN contains(metric, 'min') THEN min(value) ELSE avg(value) END, 5) AS value FROM m GROUP BY metric")
def a6_reduce_metrics(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events")
    tail = F.when(F.col("user_id") % 3 == 0, "/max").when(F.col("user_id") % 3 == 1, "/minmax_diff").otherwise("/mean")
    long = ev.select(F.concat("event_type", tail).alias("metric"), "value").unionByName(ev.where("user_id % 5 = 0").select(F.concat("event_type", F.lit("/min")).alias("metric"), "value"))
    return M.reduce_metrics(long).select("metric", F.round("value", 5).alias("value"))


@query(f"""WITH {SCORED}, p AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY uid) AS m FROM s),
k AS (SELECT uid, draw, floor(('0x' || substr(md5('42:' || uid || ':' || draw || ':' || slot), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * m)::BIGINT AS i
  FROM (SELECT DISTINCT uid, m FROM p), (SELECT unnest(range(1000)) AS draw), (SELECT unnest(range(8)) AS slot)),
d AS (SELECT k.uid, draw, avg(score) AS mean, max(score) AS best FROM k JOIN p ON p.uid = k.uid AND p.i = k.i GROUP BY ALL)
SELECT uid, round(avg(mean), 6) AS mean_mean, round(stddev_pop(mean), 6) AS mean_std, round(avg(best), 6) AS max_mean, round(stddev_pop(best), 6) AS max_std FROM d GROUP BY uid""")
def a7_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """1,000 resamples of 8 scores per source: their mean and maximum. A test holds it against the closed form."""
    made = M.bootstrap(scored(spark, sf), ["uid"], "score", "doc_id", 8, {"mean": F.avg, "max": F.max})
    return made.select("uid", *(R6(F.col(c), c) for c in made.columns if c != "uid"))


@query(f"""WITH {SCORED}, o AS (SELECT uid, score, row_number() OVER (PARTITION BY uid ORDER BY score) AS i, count(*) OVER (PARTITION BY uid) AS m FROM s)
SELECT uid, round(sum(score * (pow(i / m, 4) - pow((i - 1) / m, 4))), 6) AS expected FROM o GROUP BY uid""")
def a7_expected_best(spark: SparkSession, sf: str) -> DataFrame:
    return M.expected_best(scored(spark, sf), ["uid"], "score", 4).select("uid", R6(F.col("expected"), "expected"))


@query("""WITH v AS (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY ALL), b AS (SELECT source, first, row_number() OVER (PARTITION BY source ORDER BY n DESC, first) AS i FROM v)
SELECT b.source, n_chars AS majority FROM b JOIN documents ON doc_id = first WHERE i = 1""")
def a8_majority(spark: SparkSession, sf: str) -> DataFrame:
    return M.majority(table(spark, sf, "documents"), ["source"], "lang", "n_chars", "doc_id")


@query(f"""WITH {SCORED}, p AS (SELECT uid, len % 5 AS prompt, avg(score) AS mean, stddev_pop(score) AS std, max(score) AS best, min(score) AS worst FROM s GROUP BY ALL)
SELECT uid, round(avg(mean), 6) AS mean, round(avg(std), 6) AS std, avg(best) AS best, avg(worst) AS worst FROM p GROUP BY uid""")
def a9_validation(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.validation(scored(spark, sf).withColumn("prompt", F.col("len") % 5), "uid", "prompt", "score")
    return rows.select("uid", R6(F.col("mean"), "mean"), R6(F.col("std"), "std"), "best", "worst")


@query("""SELECT DISTINCT event_type || '/' || CASE WHEN user_id % 4 = 0 THEN 'acc' ELSE 'reward' END || '/' || CASE WHEN user_id % 2 = 0 THEN 'mean@8' ELSE 'std@8' END AS name,
  CASE WHEN user_id % 4 = 0 AND user_id % 2 = 0 THEN 'val-core' ELSE 'val-aux' END || '/' || event_type AS section FROM events""")
def a10_metric_names(spark: SparkSession, sf: str) -> DataFrame:
    """The core variable is ``acc`` where there is one; only its mean at the largest N is a core metric."""
    u = F.col("user_id")
    name = F.concat("event_type", F.lit("/"), F.when(u % 4 == 0, "acc").otherwise("reward"), F.lit("/"), F.when(u % 2 == 0, "mean@8").otherwise("std@8"))
    section = F.concat(F.when((u % 4 == 0) & (u % 2 == 0), "val-core").otherwise("val-aux"), F.lit("/"), F.col("event_type"))
    return table(spark, sf, "events").select(name.alias("name"), section.alias("section")).distinct()


@query(f"WITH {SCORED}, r AS (SELECT uid, len % 7 AS row_id, avg(score) AS m FROM s GROUP BY ALL) SELECT uid, round(avg(m), 6) AS score FROM r GROUP BY uid")
def a11_offline_eval(spark: SparkSession, sf: str) -> DataFrame:
    per = scored(spark, sf).groupBy("uid", (F.col("len") % 7).alias("row_id")).agg(F.avg("score").alias("m"))
    return per.groupBy("uid").agg(R6(F.avg("m"), "score"))


@query("""WITH l AS (SELECT len(string_split(text, ' ')) AS n FROM documents) SELECT count(*) AS n, round(avg(n), 4) AS mean, max(n)::INT AS max, min(n)::INT AS min, median(n)::DOUBLE AS median, round(stddev_pop(n), 4) AS std FROM l""")
def a12_length_stats(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select(F.size(F.split("text", " ")).alias("n"))
    return n.agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("max"), F.min("n").alias("min"), F.percentile("n", 0.5).alias("median"), F.round(F.stddev_pop("n"), 4).alias("std")).select("n", "mean", "max", "min", "median", "std")


@query("""WITH l AS (SELECT len(string_split(text, ' ')) AS n FROM documents), b AS (SELECT unnest([0, 100, 500]) AS a, unnest([100, 500, 100000]) AS z)
SELECT a || '-' || z AS bin, count(*) FILTER (n BETWEEN a AND z) AS count, round(100 * count(*) FILTER (n BETWEEN a AND z) / count(*), 2) AS percent FROM l, b GROUP BY a, z""")
def j11_histogram(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select(F.size(F.split("text", " ")).alias("n"))
    return M.histogram(n, "n", [(0, 100), (100, 500), (500, 100_000)])


@query("""WITH l AS (SELECT doc_id // 100 AS rank, sum(n_chars) AS s FROM documents GROUP BY 1) SELECT max(s)::BIGINT AS max, min(s)::BIGINT AS min, (max(s) - min(s))::BIGINT AS diff, round(avg(s), 4) AS mean FROM l""")
def a13_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("rank")).agg(F.sum("n_chars").alias("s"))
    return s.agg(F.max("s").alias("max"), F.min("s").alias("min"), (F.max("s") - F.min("s")).alias("diff"), F.round(F.avg("s"), 4).alias("mean"))


@query(f"""WITH {TOKENS} SELECT uid, round(sum(reward * mask), 5) AS total, round(sum(reward * mask) / (sum(mask) + 1e-8), 6) AS mean, round(var_samp(reward) FILTER (mask = 1), 5) AS var FROM k GROUP BY uid HAVING sum(mask) > 1""")
def a14_a16_masked_reductions(spark: SparkSession, sf: str) -> DataFrame:
    r, m = F.col("reward"), F.col("mask")
    rows = tokens(spark, sf).groupBy("uid").agg(F.round(F.sum(r * m), 5).alias("total"), R6(L.masked_mean(r, m), "mean"), F.round(F.var_samp(F.when(m == 1, r)), 5).alias("var"), F.sum(m).alias("n"))
    return rows.where("n > 1").drop("n")


@query(f"""WITH {TOKENS}, m AS (SELECT avg(reward) FILTER (mask = 1) AS a, var_samp(reward) FILTER (mask = 1) AS v FROM k) SELECT event_id, round((reward - a) / sqrt(v + 1e-8), 5) AS white FROM k, m""")
def a17_whiten(spark: SparkSession, sf: str) -> DataFrame:
    return W.whitened(tokens(spark, sf), "reward", "mask").select("event_id", F.round("white", 5).alias("white"))


@query(f"WITH {TOKENS} SELECT round(avg(reward), 6) AS mean, max(reward) AS max, min(reward) AS min, round(stddev_samp(reward), 6) AS std, round(sum(reward * mask) / sum(mask), 6) AS masked, round(corr(old_logp, ref_logp) FILTER (mask = 1), 6) AS pearson FROM k")
def a18_a19_a21_distributed_stats(spark: SparkSession, sf: str) -> DataFrame:
    r, m = F.col("reward"), F.col("mask")
    live = lambda c: F.when(m == 1, F.col(c))
    return tokens(spark, sf).agg(R6(F.avg(r), "mean"), F.max(r).alias("max"), F.min(r).alias("min"), R6(F.stddev_samp(r), "std"), R6(F.sum(r * m) / F.sum(m), "masked"), R6(F.corr(live("old_logp"), live("ref_logp")), "pearson"))


@query(f"WITH {TOKENS}, d AS (SELECT abs(exp(old_logp) - exp(ref_logp)) AS d FROM k WHERE mask = 1) SELECT round(max(d), 6) AS max, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS std FROM d")
def a22_probability_drift(spark: SparkSession, sf: str) -> DataFrame:
    d = F.abs(F.exp("old_logp") - F.exp("ref_logp"))
    return tokens(spark, sf).where("mask = 1").agg(R6(F.max(d), "max"), R6(F.avg(d), "mean"), R6(F.stddev_samp(d), "std"))


@query(f"WITH {TOKENS} SELECT uid, count(*) FILTER (mask = 1 AND round(reward * 2) <> round(value * 2)) AS differing FROM k GROUP BY uid")
def a23_token_differences(spark: SparkSession, sf: str) -> DataFrame:
    d = (F.col("mask") == 1) & (F.round(F.col("reward") * 2) != F.round(F.col("value") * 2))
    return tokens(spark, sf).groupBy("uid").agg(F.count_if(d).alias("differing"))


@query("""WITH l AS (SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END AS priority, l_returnflag AS status, l_discount AS score FROM lineitem)
SELECT l_orderkey, min(status) FILTER (priority = p) AS status, min(score) AS score, round(min(score) * 30, 4) AS points FROM (SELECT *, min(priority) OVER (PARTITION BY l_orderkey) AS p FROM l) GROUP BY l_orderkey""")
def a24_subtask_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """The worst status by priority, the least score, and its points."""
    p = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_returnflag", p).alias("status"), F.min("l_discount").alias("score"), F.round(F.min("l_discount") * 30, 4).alias("points"))


@query("""SELECT l_orderkey, round(avg((l_quantity > 10)::INT), 6) AS fraction, CASE WHEN min((l_quantity > 10)::INT) = 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS pass_fail, round(CASE WHEN min((l_quantity > 10)::INT) = 1 THEN 1.0 ELSE 0.0 END + 0.1 * avg((l_quantity > 10)::INT), 6) AS weighted FROM lineitem GROUP BY l_orderkey""")
def a25_submission_scores(spark: SparkSession, sf: str) -> DataFrame:
    ok = (F.col("l_quantity") > 10).cast("int")
    whole = F.when(F.min(ok) == 1, 1.0).otherwise(0.0)
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(R6(F.avg(ok), "fraction"), whole.alias("pass_fail"), R6(whole + 0.1 * F.avg(ok), "weighted"))


@query("SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 5) AS mean, max_by(event_id, value) AS slowest FROM events GROUP BY event_type")
def a26_performance(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.round(F.avg("value"), 5).alias("mean"), F.max_by("event_id", "value").alias("slowest"))


@query("SELECT conv_id, list(role ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def a27_u13_collect(spark: SparkSession, sf: str) -> DataFrame:
    return B.gathered(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "roles")


@query(f"""WITH {SCORED}, p AS (SELECT a.uid, abs(a.score - b.score) AS w, (sign(a.len - b.len) = sign(a.score - b.score))::INT AS ok FROM s a JOIN s b ON a.uid = b.uid AND a.doc_id < b.doc_id AND a.score <> b.score),
g AS (SELECT uid, sum(w * ok) / sum(w) AS v FROM p GROUP BY uid) SELECT uid, round(coalesce(v, 0.5), 6) AS agreement FROM (SELECT DISTINCT uid FROM s) LEFT JOIN g USING (uid)""")
def a28_j13_pair_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return M.pair_agreement(scored(spark, sf), "uid", "len", "score").select("uid", R6(F.col("agreement"), "agreement"))


@query(f"WITH {SCORED} SELECT round(avg((sign(len - 300) = sign(2 * (score = 1)::INT - 1))::INT), 6) AS accuracy FROM s")
def a29_absolute_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.signum(F.col("len") - 300.0) == F.signum(2.0 * (F.col("score") == 1).cast("int") - 1)
    return scored(spark, sf).agg(R6(F.avg(ok.cast("int")), "accuracy"))


@query("""WITH w AS (SELECT item_id, regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark),
g AS (SELECT item_id, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)) SELECT gram, list_sort(list(DISTINCT item_id)) AS items FROM g GROUP BY gram""")
def a30_ngram_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return FI.ngram_lookup(table(spark, sf, "benchmark"), "item_id", "text", 8)


@query("SELECT round(avg(l_discount), 6) AS l_discount, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def a31_extra_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_quantity").alias("score"), "l_discount", "l_tax")
    return rows.agg(*(R6(F.avg(c), c) for c in rows.columns if c != "score"))


@query("""WITH w AS (SELECT item_id AS id, regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM benchmark), b AS (SELECT DISTINCT array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
x AS (SELECT doc_id AS id, regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents), c AS (SELECT DISTINCT id FROM (SELECT id, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - 6)) AS i FROM x WHERE len(w) >= 8)) SEMI JOIN b USING (g))
SELECT doc_id, doc_id IN (SELECT id FROM c) AS contaminated FROM documents""")
def j4_contamination(spark: SparkSession, sf: str) -> DataFrame:
    """Flags per document: it shares 8 words in a row with an item."""
    return FI.flag_contaminated(table(spark, sf, "documents"), "doc_id", "text", {"contaminated": table(spark, sf, "benchmark")}).select("doc_id", "contaminated")


@query(ORACLE_SQL["j4_contamination"].replace("SELECT doc_id, doc_id IN (SELECT id FROM c) AS contaminated FROM documents", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT id FROM c)"))
def f4_cleanup(spark: SparkSession, sf: str) -> DataFrame:
    flagged = FI.flag_contaminated(table(spark, sf, "documents"), "doc_id", "text", {"contaminated": table(spark, sf, "benchmark")})
    return FI.cleanup(flagged, ["contaminated"]).select("doc_id", "source")


@query("SELECT doc_id FROM documents WHERE len(string_split(text, ' ')) <= 200")
def f1_length_filter(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where(F.size(F.split("text", " ")) <= 200).select("doc_id")


@query(f"WITH {SCORED}, a AS (SELECT uid, avg(CASE WHEN score <> 0 THEN score END) AS m FROM s GROUP BY uid) SELECT uid, round(m, 6) AS rate FROM a WHERE m > 0.2 AND m < 0.8")
def f2_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    """Strict bounds on the mean of rewards that aren't null."""
    rewards = scored(spark, sf).groupBy("uid").agg(F.collect_list(F.when(F.col("score") != 0, F.col("score"))).alias("rewards"))
    return FI.pass_rate(rewards, "rewards", 0.2, 0.8).select("uid", R6(F.col("pass_rate"), "rate"))


@query("SELECT source FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING max(coalesce(toxic, 0)) < 1")
def f3_out_of_knowledge(spark: SparkSession, sf: str) -> DataFrame:
    """Groups none of whose verdicts is 1, through an array of verdict structs."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").groupBy("source").agg(F.collect_list(F.struct(F.col("toxic").alias("score"))).alias("judge"))
    return FI.out_of_knowledge(rows, "judge").select("source")


@query("SELECT o_orderkey FROM orders WHERE strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-00' AND strftime(o_orderdate, '%Y-%m-%d') < '1996-07-00'")
def f5_date_window(spark: SparkSession, sf: str) -> DataFrame:
    """Half-open bounds compared as strings, as they may hold a day 00."""
    return FI.string_window(table(spark, sf, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")), "day", "1996-01-00", "1996-07-00").select("o_orderkey")


@query("SELECT page_id FROM pages WHERE length(regexp_extract(html, '<title>([^<]*)</title>', 1)) > 0")
def f6_nonempty_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").where(F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)) > 0).select("page_id")


@query(f"WITH {SCORED} SELECT doc_id, uid FROM (SELECT *, stddev_pop(score) OVER (PARTITION BY uid) AS sd, count(*) OVER (PARTITION BY uid) AS n FROM s) WHERE sd > 0 OR n = 1")
def f7_j7_group_filter(spark: SparkSession, sf: str) -> DataFrame:
    return FI.varied_groups(scored(spark, sf), "uid", "score").select("doc_id", "uid")


@query(f"""WITH {SCORED}, g AS (SELECT uid, avg(score) BETWEEN 0.3 AND 0.9 AND max(len) < 4000 AS ok FROM s GROUP BY uid), o AS (SELECT doc_id, ok, row_number() OVER (ORDER BY ok DESC, uid, doc_id) AS i, count(*) OVER () AS n FROM s JOIN g USING (uid))
SELECT doc_id, ok FROM o WHERE i <= n // 2""")
def f8_k5_filter_and_downsample(spark: SparkSession, sf: str) -> DataFrame:
    return FI.filter_and_downsample(scored(spark, sf), "uid", "score", "len", (0.3, 0.9), 4001, 2, "doc_id").select("doc_id", "ok")


@query("SELECT doc_id FROM documents WHERE doc_id >= 100 AND doc_id < 200")
def f9_range_select(spark: SparkSession, sf: str) -> DataFrame:
    """Only with both bounds; one alone selects all."""
    rows = B.with_row_id(table(spark, sf, "documents"), "doc_id")
    return FI.range_select(FI.range_select(rows, 5, None), 100, 200).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def f10_j8_resume(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    done = docs.where("doc_id % 3 = 0").select(F.md5(F.col("doc_id").cast("string")).alias("hash"))
    return FI.resume(docs, "doc_id", done, "hash").select("doc_id")


@query("SELECT page_id FROM pages WHERE replace(url, '-', '') = (SELECT replace(url, '-', '') FROM pages WHERE page_id = 7) ORDER BY page_id LIMIT 1")
def f11_lookup(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    bare = F.replace(F.col("url"), F.lit("-"), F.lit(""))
    wanted = pages.where("page_id = 7").select(bare.alias("bare"))
    return pages.withColumn("bare", bare).join(wanted, "bare", "left_semi").orderBy("page_id").limit(1).select("page_id")


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE CASE WHEN quality IS NOT NULL THEN quality >= 1 WHEN n_chars % 2 = 0 THEN n_chars % 5 >= 3 ELSE true END")
def f12_reference_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The first score wins where it isn't null, else the second; rows with neither are kept."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    second = F.when(F.col("n_chars") % 2 == 0, F.col("n_chars") % 5)
    return rows.where(FI.reference_kept(F.col("quality"), 1, second, 3)).select("doc_id")


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS flagged FROM customer")
def j1_membership(spark: SparkSession, sf: str) -> DataFrame:
    return B.membership(table(spark, sf, "customer"), "c_custkey", table(spark, sf, "orders"), "o_custkey", "flagged").select("c_custkey", "flagged")


@query("SELECT l_orderkey, list(p_brand ORDER BY l_linenumber, l_partkey) AS brands FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def j2_j3_p8_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Items looked up by id for each row's list, in the list's order."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("x"))
    rows = lists.select("l_orderkey", F.transform("x", lambda e: e["l_partkey"]).alias("ids"))
    return B.lookup_lists(rows, "l_orderkey", "ids", table(spark, sf, "part"), "p_partkey", "p_brand", "brands")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def j5_j6_column_union(spark: SparkSession, sf: str) -> DataFrame:
    """Two column sets of the same rows; the shared column has to agree."""
    o = table(spark, sf, "orders")
    return B.column_union(o.select("o_orderkey", "o_orderstatus"), o.select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey").select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT doc_id, source || ':' || coalesce(quality, -1) AS zipped FROM documents LEFT JOIN labels USING (doc_id)")
def j9_judge_zip(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", F.concat_ws(":", "source", F.coalesce("quality", F.lit(-1)).cast("string")).alias("zipped"))


@query("SELECT s_suppkey, coalesce(n, 0) + 1 AS cases FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def j10_test_case_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Official cases and generated ones by id, where those may be missing."""
    more = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list("l_orderkey").alias("more"))
    rows = table(spark, sf, "supplier").join(more, F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return rows.select("s_suppkey", F.size(F.concat(F.array("s_suppkey"), F.coalesce("more", F.array().cast("array<bigint>")))).cast("bigint").alias("cases"))


@query("SELECT r_regionkey, i FROM region, (SELECT unnest(range(3)) AS i) WHERE r_regionkey + 1 > i")
def k15_k16_repeat(spark: SparkSession, sf: str) -> DataFrame:
    """Per-row counts: region r is repeated r + 1 times, three at most."""
    return B.repeated(table(spark, sf, "region"), F.least(F.col("r_regionkey") + 1, F.lit(3)), "i").select("r_regionkey", F.col("i").cast("bigint").alias("i"))


@query("SELECT n_nationkey, (n_nationkey * 2 + c)::BIGINT AS interleaved, (c * 25 + n_nationkey)::BIGINT AS tiled FROM nation, (SELECT unnest(range(2)) AS c)")
def k15_repeat_orders(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.repeated(B.with_row_id(table(spark, sf, "nation"), "n_nationkey"), F.lit(2), "c")
    n = table(spark, sf, "nation").count()
    return rows.select("n_nationkey", (F.col("row_id") * 2 + F.col("c")).alias("interleaved"), (F.col("c") * n + F.col("row_id")).cast("bigint").alias("tiled"))


@query("SELECT n_nationkey, i FROM (SELECT n_nationkey, n_nationkey::BIGINT AS i FROM nation UNION ALL SELECT n_nationkey, 25 + n_nationkey FROM nation WHERE n_nationkey < 3)")
def k17_k18_pad(spark: SparkSession, sf: str) -> DataFrame:
    """25 rows to a multiple of 7 by leading rows; unpadding gives the rows back."""
    rows = B.with_row_id(table(spark, sf, "nation"), "n_nationkey")
    out, pad = B.pad_to_divisor(rows, 7)
    if B.unpad(out, pad).count() != rows.count():
        raise ValueError("unpadding lost rows")
    return out.select("n_nationkey", F.col("row_id").alias("i"))


@query("SELECT n_nationkey, count(*) AS n FROM (SELECT n_nationkey FROM nation UNION ALL SELECT 24 FROM range(3)) GROUP BY 1")
def k19_pad_last(spark: SparkSession, sf: str) -> DataFrame:
    return B.pad_with_last(B.with_row_id(table(spark, sf, "nation"), "n_nationkey"), 3).groupBy("n_nationkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 10 AND 99 AND (o_orderkey - 10) % 7 = 0")
def k13_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.with_row_id(table(spark, sf, "orders"), "o_orderkey")
    low = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    return B.sliced(rows, 10 - low, 100 - low, 7).select("o_orderkey")


@query("SELECT n_nationkey, p FROM (SELECT n_nationkey, (24 - n_nationkey)::BIGINT AS p FROM nation)")
def k12_k14_k24_reorder(spark: SparkSession, sf: str) -> DataFrame:
    """Gather by a permutation; its inverse would bring the rows back."""
    rows = B.with_row_id(table(spark, sf, "nation"), "n_nationkey")
    order = rows.select(F.col("row_id").alias("place"), (24 - F.col("row_id")).alias("row_id"))
    back = B.reordered(B.reordered(rows, order), B.inverse(order))
    return B.reordered(rows, order).join(back.select("n_nationkey"), "n_nationkey").select("n_nationkey", F.col("row_id").alias("p"))


@query("SELECT (doc_id // 300)::BIGINT AS part, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1")
def u4_p21_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.split_rows(B.with_row_id(table(spark, sf, "documents"), "doc_id"), 300)
    return rows.groupBy("part").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("SELECT (n_nationkey // 5)::BIGINT AS chunk, count(*) AS n FROM nation GROUP BY 1")
def u3_chunk(spark: SparkSession, sf: str) -> DataFrame:
    return B.chunks(B.with_row_id(table(spark, sf, "nation"), "n_nationkey"), 5).groupBy("chunk").agg(F.count("*").alias("n"))


@query("SELECT r_name AS name, 'region' AS kind FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def u1_u2_u7_concat(spark: SparkSession, sf: str) -> DataFrame:
    one = B.renamed(table(spark, sf, "region").select("r_name"), {"r_name": "name"}).withColumn("kind", F.lit("region"))
    return B.concat([one, table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))])


@query("SELECT n_nationkey, n_name FROM nation")
def u5_u6_u8_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Every 5 rows to a nested row and back; a popped column is gone from the rest."""
    popped, rest = B.pop(B.with_row_id(table(spark, sf, "nation"), "n_nationkey"), ["n_regionkey"])
    if "n_regionkey" in rest.columns or popped.columns != ["n_regionkey"]:
        raise ValueError("pop")
    return B.unfold(B.fold(rest, 5)).select("n_nationkey", "n_name")


@query("SELECT vec_id, c AS chunk, list_transform(embedding[c * 16 + 1 : c * 16 + 16], lambda x: round(x::DOUBLE, 5)) AS piece FROM embeddings, (SELECT unnest(range(4)) AS c)")
def u9_column_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What rounds to zero keeps its sign, which Spark's rounding drops."""

    def rounded(x: Column) -> Column:
        near = F.round(x.cast("double"), 5)
        return F.when(near == 0, x.cast("double") * 0.0).otherwise(near)

    rows = B.column_chunks(table(spark, sf, "embeddings"), "embedding", 4, "chunk")
    return rows.select("vec_id", F.col("chunk").cast("bigint").alias("chunk"), F.transform("embedding", rounded).alias("piece"))


@query("SELECT doc_id FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id FROM documents WHERE lang = 'fr' AND n_chars > 500")
def u12_append(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return B.append(docs.where("lang = 'de'"), docs.where("lang = 'fr'"), F.col("n_chars") > 500).select("doc_id")


@query("SELECT doc_id, e AS epoch, ((doc_id) // 250)::BIGINT AS batch FROM documents, (SELECT unnest(range(2)) AS e)")
def u14_iterator(spark: SparkSession, sf: str) -> DataFrame:
    """Mini-batches over two epochs; the batch size has to divide the rows, which is checked at the smallest scale only
    where it does."""
    rows = B.with_row_id(table(spark, sf, "documents"), "doc_id")
    return B.mini_batches(rows, 250, 2, check=False).select("doc_id", F.col("epoch").cast("bigint").alias("epoch"), "batch")
