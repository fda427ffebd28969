"""Queries: prompts, conversations, retrieval, pairs, mixtures, balancing, sources and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievework.functions import arrays as A
from sievework.functions import latex as X
from sievework.functions import text as T
from sievework.functions.equality import numeric_equal
from sievework.functions.final_answer import tool_use_score
from sievework.operators import balance, mixtures, pairs, prep, retrieval
from sievework.operators.batch import gathered, with_row_id
from sievework.plans.standins import SCORED, scored, table
from sievework.sources import io
from sievework.streaming import flows

QUERIES, ORACLE_SQL = {}, {}
R6 = lambda c, name: F.round(c, 6).alias(name)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.col("text").alias("q"), F.get(F.split("text", " "), F.lit(0)).alias("a"), F.array("source").alias("alt"), (F.col("doc_id") % 7 == 0).alias("ook"))


@query("""WITH q AS (SELECT doc_id, CASE WHEN ends_with(trim(text), '?') THEN trim(text) ELSE trim(text) || '?' END AS q, string_split(text, ' ')[1] AS a, source FROM documents)
SELECT doc_id AS idx, 'questions' AS data_source, 'Answer: ' || q || ' Now.' AS content, [a, source] AS target, doc_id % 7 = 0 AS ook FROM q""")
def p1_v13_v15_question_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Question rows, with one block of the template replaced."""
    rows = prep.question_rows(_questions(spark, sf), "questions", "q", "a", "alt", F.col("ook"), "doc_id", "Think. {} Now.", replace=("Think.", "Answer:"))
    rows = prep.mapped(rows, lambda df: df)
    return rows.select(F.col("extra_info.index").alias("idx"), "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth.target").alias("target"), F.col("reward_model.ground_truth.out_of_knowledge").alias("ook"))


@query("""WITH q AS (SELECT doc_id, text || ' End with ####.' AS asked, n || ' #### ' || format('{:,}', n) AS worked, n FROM (SELECT *, coalesce(n_chars, 0) AS n FROM documents))
SELECT doc_id AS idx, 'system' AS first_role, 'Check before you answer.' AS first_content, asked AS content, n::VARCHAR AS truth, worked AS answer, true AS needs_tools, n::VARCHAR AS tool_truth,
  'checks' AS interaction, asked AS query, n::VARCHAR AS interaction_truth, 1 AS bare_messages, asked AS bare_content FROM q""")
def v16_guided_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Worked questions with a tool and an interaction, and as bare rows without a system message."""
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce("n_chars", F.lit(0)).alias("n"))
    docs = docs.withColumn("worked", F.concat_ws(" #### ", F.col("n").cast("string"), F.format_number("n", 0)))
    rows = prep.guided_rows(docs, "worked", "text", "worked", "doc_id", "End with ####.", "Check before you answer.", tools=("check",), interaction="checks")
    bare = prep.guided_rows(docs, "worked", "text", "worked", "doc_id", "End with ####.").select(F.col("extra_info.index").alias("idx"), F.col("prompt").alias("bare"))
    info, first, last = F.col("extra_info"), F.col("prompt")[0], F.col("prompt")[1]
    out = prep.mapped(rows, lambda df: df).select(
        info["index"].alias("idx"), first["role"].alias("first_role"), first["content"].alias("first_content"), last["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"),
        info["answer"].alias("answer"), info["need_tools_kwargs"].alias("needs_tools"), info["tools_kwargs"]["check"]["create_kwargs"]["ground_truth"].alias("tool_truth"),
        info["interaction_kwargs"]["name"].alias("interaction"), info["interaction_kwargs"]["query"].alias("query"), info["interaction_kwargs"]["ground_truth"].alias("interaction_truth"))
    return out.join(bare, "idx").select(*out.columns, F.size("bare").alias("bare_messages"), F.col("bare")[0]["content"].alias("bare_content"))


@query("""WITH w AS (SELECT doc_id, string_split(text, ' ') AS w FROM documents) SELECT doc_id, CASE WHEN len(w) > 50 THEN w[1:46] || w[len(w) - 3 : len(w)] ELSE w END AS kept,
  CASE WHEN len(w) > 20 THEN w[1:10] || w[len(w) - 9 : len(w)] ELSE w END AS middle, CASE WHEN len(w) > 20 THEN w[len(w) - 19 : len(w)] ELSE w END AS l, CASE WHEN len(w) > 20 THEN w[1:20] ELSE w END AS r FROM w""")
def p2_p17_y1_y4_truncation(spark: SparkSession, sf: str) -> DataFrame:
    w = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", A.head_and_tail(w, 50, 4).alias("kept"), A.truncated(w, 20, "middle").alias("middle"), A.truncated(w, 20, "left").alias("l"), A.truncated(w, 20, "right").alias("r"))


@query("SELECT doc_id, doc_id::VARCHAR || '00' AS answer, 'How? Think.' AS question FROM documents")
def p3_p4_gsm8k_rows(spark: SparkSession, sf: str) -> DataFrame:
    solution = F.concat(F.lit("so #### "), F.col("doc_id").cast("string"), F.lit(",00"))
    return table(spark, sf, "documents").select("doc_id", prep.worked_solution(solution).alias("answer"), F.concat(F.lit("How?"), F.lit(" Think.")).alias("question"))


@query("SELECT doc_id, 'search_' || source AS data_source, coalesce(quality::VARCHAR, lang) AS truth FROM documents LEFT JOIN labels USING (doc_id)")
def p5_v7_nested_coalesce(spark: SparkSession, sf: str) -> DataFrame:
    """The ground truth from a nested field, else from a plain one; the source with a prefix."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("reward_model", F.struct(F.col("quality").cast("string").alias("ground_truth")))
    return rows.select("doc_id", F.concat(F.lit("search_"), "source").alias("data_source"), F.coalesce("reward_model.ground_truth", "lang").alias("truth"))


@query("""WITH o AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents) SELECT source, string_agg('Doc ' || i || '(Title: ' || doc_id || ') ' || source || chr(10), '' ORDER BY i) AS docs FROM o WHERE i <= 3 GROUP BY source""")
def p6_p7_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("ids"))
    refs = F.transform(F.slice("ids", 1, 5), lambda d: F.struct(d.cast("string").alias("title"), F.col("source").alias("text")))
    return docs.select("source", prep.references(refs, 3).alias("docs"))


@query("""WITH h AS (SELECT page_id, trim(html) AS h FROM pages) SELECT page_id, replace(regexp_replace(replace(h || ' [title] [x]  y', ' [title]', '. '), '\\[.*?\\]', '', 'g'), '  ', ' ') AS clean, upper(substr(h, 2, 1)) || lower(substr(h, 3)) AS capital FROM h""")
def p9_p10_clean(spark: SparkSession, sf: str) -> DataFrame:
    h = F.trim("html")
    return table(spark, sf, "pages").select("page_id", T.hellaswag_clean(F.concat(h, F.lit(" [title] [x]  y"))).alias("clean"), T.mixed_case_first(F.substring(h, F.lit(2), F.length(h))).alias("capital"))


@query("SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS response FROM orders")
def p11_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    return prep.unpivoted_pairs(table(spark, sf, "orders"), "o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT c_custkey, CASE WHEN row_number() OVER (ORDER BY c_custkey) <= floor(0.75 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM customer")
def p12_v17_positional_split(spark: SparkSession, sf: str) -> DataFrame:
    return prep.positional_split(with_row_id(table(spark, sf, "customer"), "c_custkey"), 0.75).select("c_custkey", "split")


@query("SELECT p_partkey, 4 AS n, true AS right_in_place FROM part")
def p14_shuffled_choices(spark: SparkSession, sf: str) -> DataFrame:
    """Which order comes out depends on the hash; that the letter names the right choice does not."""
    rows = table(spark, sf, "part").withColumn("c", prep.shuffled_choices(F.col("p_partkey"), F.col("p_name"), F.array(*map(F.lit, "xyz")), 7))
    at = F.instr(F.lit("ABCD"), F.col("c.answer"))
    return rows.select("p_partkey", F.size("c.choices").alias("n"), (F.element_at("c.choices", at) == F.col("p_name")).alias("right_in_place"))


@query("SELECT doc_id, ['assistant', 'tool', 'assistant'] AS roles, [source || ' <code>x</code>', '1', '<answer>2</answer>'] AS contents FROM documents")
def p15_code_turns(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat("source", F.lit(" <code>x</code><interpreter>1</interpreter><answer>2</answer>"))
    turns = prep.code_turns(text)
    return table(spark, sf, "documents").select("doc_id", F.transform(turns, lambda t: t["role"]).alias("roles"), F.transform(turns, lambda t: t["content"]).alias("contents"))


@query("""WITH o AS (SELECT source, text, doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS upto, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents)
SELECT source, coalesce(string_agg('# Reference ' || i || chr(10) || text || chr(10), '' ORDER BY i) FILTER (upto <= 15000), '') AS prompt FROM o GROUP BY source""")
def p16_reference_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = gathered(table(spark, sf, "documents"), ["source"], "doc_id", "text", "refs")
    return rows.select("source", prep.budgeted_references(F.col("refs"), 15_000).alias("prompt"))


@query("WITH w AS (SELECT doc_id, string_split(text, ' ') AS w, (doc_id % 50)::INT AS n FROM documents) SELECT doc_id, w[1 : least(len(w), 60 - n)] AS prompt FROM w")
def p18_fitted_prompt(spark: SparkSession, sf: str) -> DataFrame:
    completion = F.array_repeat(F.lit("x"), (F.col("doc_id") % 50).cast("int"))
    return table(spark, sf, "documents").select("doc_id", prep.fitted_prompt(F.split("text", " "), completion, 60).alias("prompt"))


@query("SELECT doc_id, ['text', 'image', 'text', 'video'] AS types, [source, '', ' then ', ''] AS texts FROM documents")
def p19_segments(spark: SparkSession, sf: str) -> DataFrame:
    s = prep.segments(F.concat("source", F.lit("<image> then <video>")))
    return table(spark, sf, "documents").select("doc_id", F.transform(s, lambda x: x["type"]).alias("types"), F.transform(s, lambda x: x["text"]).alias("texts"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN ['system', 'user'] ELSE ['user'] END AS roles FROM documents")
def p20_conversation(spark: SparkSession, sf: str) -> DataFrame:
    c = prep.conversation(F.when(F.col("doc_id") % 2 == 0, F.lit("be brief")), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.transform(c, lambda m: m["role"]).alias("roles"))


@query("SELECT n_nationkey, length(n_name) - length(replace(n_name, 'A', '')) AS count, 'How many A are there in word ' || n_name || '?' AS prompt FROM nation")
def p22_letter_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = prep.letter_counts(F.col("n_nationkey"), F.col("n_name"), F.lit("A"))
    return table(spark, sf, "nation").select("n_nationkey", c["count"].cast("bigint").alias("count"), c["prompt"].alias("prompt"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '#include <a>' || chr(10) || 'x' ELSE '#include <a>' END AS code, CASE WHEN doc_id % 2 = 0 THEN 'a = 1' || chr(10) || 'print(a)' || chr(10) ELSE 'print(2)' END AS wrapped FROM documents")
def p25_v8_code_patches(spark: SparkSession, sf: str) -> DataFrame:
    even = F.col("doc_id") % 2 == 0
    code = F.when(even, F.lit("x")).otherwise(F.lit("#include <a>"))
    body = F.when(even, F.lit("a = 1\na\n")).otherwise(F.lit("print(2)"))
    return table(spark, sf, "documents").select("doc_id", prep.with_includes(code, ["#include <a>"]).alias("code"), prep.print_wrapped(body).alias("wrapped"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN ['a', source] WHEN 1 THEN [source] ELSE [] END AS alt FROM documents")
def y9_alternatives(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("['a', '"), "source", F.lit("']"))).when(F.col("doc_id") % 3 == 1, F.col("source")).otherwise(F.lit(""))
    return table(spark, sf, "documents").select("doc_id", prep.alternatives(raw).alias("alt"))


@query("""SELECT vec_id, (vec_id % 5 + 1)::INT AS n, list_transform(range(7), lambda i: CASE WHEN i < vec_id % 5 + 1 THEN i ELSE -1 END)::BIGINT[] AS padded, list_transform(range(7), lambda i: CASE WHEN i >= 6 - vec_id % 5 THEN i - (6 - vec_id % 5) ELSE -1 END)::BIGINT[] AS left_padded FROM embeddings""")
def y2_y3_padding(spark: SparkSession, sf: str) -> DataFrame:
    """Right and left padding to a width, and the left padding taken off by its mask."""
    ids = F.transform(F.sequence(F.lit(0), (F.col("vec_id") % 5).cast("int")), lambda x: x.cast("bigint"))
    pad = F.lit(-1).cast("bigint")
    rows = table(spark, sf, "embeddings").select("vec_id", A.padded(ids, 7, pad).alias("padded"), A.padded(ids, 7, pad, left=True).alias("left_padded"))
    mask = F.transform("left_padded", lambda x: (x >= 0).cast("int"))
    return rows.select("vec_id", F.size(A.without_left_padding(F.col("left_padded"), mask)).alias("n"), "padded", "left_padded")


@query("""SELECT conv_id, sum(len(string_split(text, ' ')))::BIGINT AS words, sum(CASE WHEN role = 'assistant' THEN len(string_split(text, ' ')) ELSE 0 END)::BIGINT AS live FROM conversations GROUP BY conv_id""")
def y5_y6_loss_mask(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    mask = prep.loss_mask(F.col("m"))
    return rows.select("conv_id", F.size(mask).cast("bigint").alias("words"), F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("live"))


@query("SELECT conv_id, max_by(text, turn) FILTER (role = 'assistant') AS last FROM conversations GROUP BY conv_id")
def r35_last_assistant(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", F.when(F.col("role") == "assistant", F.col("turn"))).alias("last"))


@query("SELECT event_id, user_id, value - CASE WHEN value > coalesce(lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) THEN 0 ELSE 0.05 END AS reward FROM events")
def r34_v12_improvement_penalty(spark: SparkSession, sf: str) -> DataFrame:
    """A call that doesn't improve on the one before costs 0.05."""
    before = F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit(0.0))
    return table(spark, sf, "events").select("event_id", "user_id", (F.col("value") - F.when(F.col("value") > before, 0.0).otherwise(0.05)).alias("reward"))


@query("""WITH l AS (SELECT doc_id, source, length(text) AS n, doc_id % 3 <> 0 AS ok FROM documents), b AS (SELECT *, min(n) OVER (PARTITION BY source) AS lo, max(n) OVER (PARTITION BY source) AS hi FROM l)
SELECT doc_id, round(CASE WHEN hi = lo THEN 0 WHEN ok THEN 0.5 - (n - lo) / (hi - lo) ELSE least(0, 0.5 - (n - lo) / (hi - lo)) END, 6) AS reward FROM b""")
def r21_length_reward(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("source")
    n = F.length("text")
    rows = table(spark, sf, "documents").withColumns({"n": n, "lo": F.min(n).over(w), "hi": F.max(n).over(w)})
    lam = 0.5 - F.try_divide((F.col("n") - F.col("lo")).cast("double"), F.col("hi") - F.col("lo"))
    return rows.select("doc_id", R6(F.when(F.col("hi") == F.col("lo"), 0.0).when(F.col("doc_id") % 3 != 0, lam).otherwise(F.least(F.lit(0.0), lam)), "reward"))


@query("""WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value > 5 AS ok, event_type = 'error' AS bad FROM events),
f AS (SELECT *, min(i) FILTER (bad) OVER (PARTITION BY user_id) AS stop FROM e) SELECT user_id, round(avg(CASE WHEN stop IS NOT NULL AND i > stop THEN 0 ELSE ok::INT END), 6) AS rate FROM f WHERE i <= 10 GROUP BY user_id""")
def r15_r16_first_ten(spark: SparkSession, sf: str) -> DataFrame:
    """The pass rate of the first ten cases; after a first compile error all later ones fail."""
    w = Window.partitionBy("user_id")
    rows = table(spark, sf, "events").withColumn("i", F.row_number().over(w.orderBy("ts", "event_id")))
    rows = rows.withColumn("stop", F.min(F.when(F.col("event_type") == "error", F.col("i"))).over(w)).where("i <= 10")
    ok = F.when(F.col("i") > F.coalesce("stop", F.lit(1 << 30)), 0).otherwise((F.col("value") > 5).cast("int"))
    return rows.groupBy("user_id").agg(R6(F.avg(ok), "rate"))


@query("SELECT l_orderkey, CASE WHEN avg((l_quantity > 5)::INT) > 0.99 THEN 1 ELSE 0 END AS binary_, bool_and(l_quantity > 5) AS every FROM lineitem GROUP BY l_orderkey")
def r26_v5_binary_code(spark: SparkSession, sf: str) -> DataFrame:
    ok = F.col("l_quantity") > 5
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.when(F.avg(ok.cast("int")) > 0.99, 1).otherwise(0).alias("binary_"), F.bool_and(ok).alias("every"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM (SELECT event_id, user_id, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM events))")
def v1_trajectory_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """The number of a row within its run of equal values."""
    order = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf, "events").withColumn("new", F.when(F.col("event_type") == F.lag("event_type").over(order), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    return rows.select("event_id", F.row_number().over(Window.partitionBy("user_id", "run").orderBy("event_id")).alias("nth"))


@query("SELECT doc_id, source AS query, 2 AS titles, '[1]' AS results FROM documents")
def v4_tool_result(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.concat(F.lit("{'query': '"), "source", F.lit("', 'results': [1], 'x': [{'title': 1}, {'title': 2}]}"))
    r = prep.tool_result(reply)
    return table(spark, sf, "documents").select("doc_id", r["query"].alias("query"), r["titles"].alias("titles"), r["results"].alias("results"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1.0 ELSE least(-1.0 + (doc_id % 9 - 2) / 2 * 0.1, 0) END::DOUBLE AS score, (n_chars + CASE WHEN doc_id % 2 = 0 THEN 0 ELSE 1 END)::VARCHAR AS pred FROM documents")
def v6_tool_score(spark: SparkSession, sf: str) -> DataFrame:
    """A wrong answer gains for its tool turns, up to 0."""
    answer = F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).otherwise(F.col("n_chars") + 1).cast("string")
    s = tool_use_score(F.concat(F.lit("so \\boxed{"), answer, F.lit("}")), F.col("n_chars").cast("string"), F.col("doc_id") % 9)
    return table(spark, sf, "documents").select("doc_id", s["score"].alias("score"), s["pred"].alias("pred"))


@query("SELECT p_partkey, abs(p_retailprice - p_size * 25) <= 0.25 * greatest(abs(p_retailprice), abs(p_size * 25)) AS equal FROM part")
def v11_numeric_equal(spark: SparkSession, sf: str) -> DataFrame:
    equal = numeric_equal(F.col("p_retailprice"), F.col("p_size") * 25.0, 0.25)
    return table(spark, sf, "part").select("p_partkey", equal.alias("equal"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '{' || source || '}' ELSE source END AS boxed, doc_id % 3 <> 2 AS equal, doc_id % 3 <> 2 AS math FROM documents")
def x10_x17_t19_boxes_and_equality(spark: SparkSession, sf: str) -> DataFrame:
    """Balanced boxes; LaTeX and numeric equality. The tests hold literal cases."""
    even = F.col("doc_id") % 2 == 0
    text = F.when(even, F.concat(F.lit("\\boxed{0} so \\boxed{{"), "source", F.lit("}}"))).otherwise(F.concat(F.lit("\\fbox{a} \\boxed{"), "source", F.lit("}")))
    a = F.when(F.col("doc_id") % 3 == 0, F.lit("\\frac12")).when(F.col("doc_id") % 3 == 1, F.lit("0.5")).otherwise(F.lit("7"))
    return table(spark, sf, "documents").select("doc_id", X.boxed_answer(text).alias("boxed"), X.is_equivalent(a, F.lit("1/2")).alias("equal"), X.is_math_equal(a, F.lit("\\dfrac{1}{2}")).alias("math"))


@query("""SELECT p_partkey, round(1 - 2.0 * len(list_distinct(flatten(list_transform(range(len(p_name)), lambda i: list_transform(range(i + 1, len(p_name) + 1), lambda j: substr(p_name, i + 1, j - i))))))
  / (len(p_name) * (len(p_name) + 1)), 9) AS repeatness FROM part""")
def v9_repeatness_of_names(spark: SparkSession, sf: str) -> DataFrame:
    """On short texts; the SQL counts distinct substrings: what isn't distinct is what common prefixes of suffixes sum to."""
    return table(spark, sf, "part").select("p_partkey", F.round(X.repeatness_score(F.col("p_name")), 9).alias("repeatness"))


@query()
def v9_repeatness(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", (X.repeatness_score(F.col("text")) > 0.2).alias("repeats"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT query_id, vec_id, list_inner_product(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM q, embeddings),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 10""")
def k1_j12_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    found = retrieval.dense_topk(e, e.where("vec_id % 50 = 0"), 10)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", R6(F.col("score"), "score"))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '') AS w FROM documents), m AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
p AS (SELECT doc_id, term, count(*) AS tf, max(l) AS l FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM t) GROUP BY ALL), d AS (SELECT term, ln(1 + (max(m.n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM p, m GROUP BY term),
q AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\pL\\pN]+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, sum(qtf * idf * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * l / mean))) AS score FROM q JOIN p USING (term) JOIN d USING (term), m GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) SELECT item_id, rank, doc_id, round(score, 4) AS score FROM r WHERE rank <= 5""")
def k2_bm25(spark: SparkSession, sf: str) -> DataFrame:
    found = retrieval.bm25_topk(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 5, "doc_id", "text", "item_id", "text")
    return found.select("item_id", F.col("rank").cast("bigint").alias("rank"), "doc_id", F.round("score", 4).alias("score"))


@query("SELECT doc_id, string_split(text, chr(10))[1] AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body FROM documents")
def k2_title_and_text(spark: SparkSession, sf: str) -> DataFrame:
    t = retrieval.title_and_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", t["title"].alias("title"), t["text"].alias("body"))


@query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) SELECT vec_id, round(e[1] / sqrt(list_inner_product(e, e)), 6) AS first FROM e")
def y11_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", R6(retrieval.normalized(F.col("embedding"))[0], "first"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'query: ' ELSE 'passage: ' END || source AS text FROM documents")
def y12_prefixes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.concat(F.when(F.col("doc_id") % 2 == 0, "query: ").otherwise("passage: "), "source").alias("text"))


@query(f"WITH {SCORED} SELECT uid, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id) AS i FROM s) WHERE i = 1")
def k3_best_of_k(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators.metrics import best_of_k

    return best_of_k(scored(spark, sf), ["uid"], "score", "doc_id").select("uid", "doc_id", "score")


@query(f"""WITH {SCORED}, o AS (SELECT uid, doc_id, score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, doc_id) AS hi, row_number() OVER (PARTITION BY uid ORDER BY score, doc_id) AS lo FROM s)
SELECT uid, max(doc_id) FILTER (hi = 1) AS chosen, max(doc_id) FILTER (lo = 1) AS rejected, max(score) - min(score) AS margin FROM o GROUP BY uid HAVING max(score) > min(score)""")
def k4_max_min_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = scored(spark, sf).groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("doc_id", "score"))).alias("x"))
    arrays = rows.select("uid", F.transform("x", lambda e: e["doc_id"]).alias("responses"), F.transform("x", lambda e: e["score"]).alias("rewards"))
    return pairs.choose(arrays, "uid", "responses", "rewards", "max_min")


@query("SELECT doc_id, coalesce(quality, toxic, 0) AS score FROM documents LEFT JOIN labels USING (doc_id) ORDER BY score DESC, doc_id LIMIT 50")
def k6_sorted_results(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").withColumn("score", F.coalesce("quality", "toxic", F.lit(0)))
    return rows.orderBy(F.desc("score"), "doc_id").limit(50).select("doc_id", "score")


@query("SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 10")
def k7_logged_generations(spark: SparkSession, sf: str) -> DataFrame:
    return mixtures.first_by_hash(table(spark, sf, "documents").select("doc_id", "source"), 10, 42, "doc_id")


@query("""WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('42:' || doc_id), doc_id) AS i, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang FROM r WHERE i <= CASE lang WHEN 'en' THEN floor(n * 0.25) WHEN 'fr' THEN floor(n * 0.5) WHEN 'de' THEN n END""")
def k8_mixture(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    parts = [(docs.where(F.col("lang") == lang), weight) for lang, weight in (("en", 0.25), ("fr", 0.5), ("de", None))]
    return mixtures.mixture(parts, "doc_id")


@query("""SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('1:' || doc_id), doc_id) <= ceil(count(*) OVER () * 0.2 - 1e-9) THEN 'test' ELSE 'train' END AS split FROM documents""")
def k9_split(spark: SparkSession, sf: str) -> DataFrame:
    train, test = mixtures.train_test_split(table(spark, sf, "documents").select("doc_id"), 0.2, 1, "doc_id")
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS row_id FROM documents")
def k10_sampler(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded random order."""
    rows = with_row_id(table(spark, sf, "documents").select("doc_id", F.struct(mixtures.hash_order(3, "doc_id"), "doc_id").alias("h")), "h")
    return rows.select("doc_id", "row_id")


@query(f"""WITH {SCORED}, w AS (SELECT doc_id, score, score * score + 1e-8::DOUBLE AS w FROM s),
c AS (SELECT doc_id, score, sum(w) OVER (ORDER BY doc_id) / sum(w) OVER () AS high, w / sum(w) OVER () AS share FROM w),
d AS (SELECT i AS draw, ('0x' || substr(md5('5:' || i), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM (SELECT unnest(range(500)) AS i))
SELECT draw::BIGINT AS draw, doc_id, score FROM d ASOF JOIN c ON d.u < c.high""")
def k11_resample(spark: SparkSession, sf: str) -> DataFrame:
    """500 draws by squared score."""
    rows = mixtures.resampled(scored(spark, sf), F.pow(F.abs("score"), F.lit(2.0)), 500, 5, "doc_id")
    return rows.select("draw", "doc_id", "score")


@query("""SELECT source AS batch, count(*) AS items, 4::BIGINT AS parts, sum(n_chars)::BIGINT AS total, true AS restored, true AS even FROM documents GROUP BY source""")
def k20_k25_balanced(spark: SparkSession, sf: str) -> DataFrame:
    """Four parts per source by largest differencing: their totals sum to the source's, differ by no more than its
    longest item, and the old order comes back by place."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    parts = balance.partitioned(docs, "source", "doc_id", "n_chars", lambda rows, total: 4)
    sums = balance.part_sums(parts, docs, "source", "doc_id", "n_chars").groupBy("source").agg(
        F.sum("items").alias("items"), F.count("*").alias("parts"), F.sum("total").alias("total"), (F.max("total") - F.min("total")).alias("spread"))
    old = Window.partitionBy("source").orderBy("doc_id")
    back = docs.withColumn("was", F.row_number().over(old) - 1).join(parts, ["source", "doc_id"])
    checked = back.groupBy("source").agg(F.bool_and(F.col("was") == F.col("place")).alias("restored"), F.max("n_chars").alias("longest"))
    return sums.join(checked, "source").select(F.col("source").alias("batch"), "items", "parts", "total", "restored", (F.col("spread") <= F.col("longest")).alias("even"))


@query("""WITH g AS (SELECT source, list(n_chars ORDER BY doc_id) AS n, list(doc_id ORDER BY doc_id) AS d, least(count(*), ceil(sum(n_chars) / 20000.0))::BIGINT AS k FROM documents GROUP BY source),
f AS (SELECT source, k, list_reduce(list_prepend({'sums': list_transform(range(k), lambda i: 0::BIGINT), 'at': 0::BIGINT, 'n': 0::BIGINT}, list_transform(n, lambda x: {'sums': []::BIGINT[], 'at': 0::BIGINT, 'n': x::BIGINT})),
  lambda a, x: {'sums': list_transform(a.sums, lambda s, i: s + CASE WHEN i = list_position(a.sums, list_min(a.sums)) THEN x.n ELSE 0 END), 'at': 0::BIGINT, 'n': 0::BIGINT}).sums AS sums FROM g)
SELECT source, k AS parts, list_sort(sums) AS totals FROM f""")
def k21_k23_micro_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Greedy parts, as many as the token limit asks for, and their totals."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "n_chars")
    parts = balance.partitioned(docs, "source", "doc_id", "n_chars", lambda rows, total: balance.micro_batch_count(rows, total, 20_000), method=balance.greedy)
    sums = balance.part_sums(parts, docs, "source", "doc_id", "n_chars")
    return sums.groupBy("source").agg(F.count("*").alias("parts"), F.array_sort(F.collect_list("total")).alias("totals"))


@query("SELECT page_id, regexp_replace(url, 'https?', 'LINK') AS url FROM pages")
def s8_masked_fields(spark: SparkSession, sf: str) -> DataFrame:
    rows = io.masked_fields(table(spark, sf, "pages").select("page_id", "url"), "https?", "LINK")
    return rows.select(F.get_json_object("page_id", "$.v").cast("bigint").alias("page_id"), "url")


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS tests FROM lineitem GROUP BY l_orderkey")
def s11_s12_tests_by_problem(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).withColumn("a", F.col("l_quantity").cast("string"))
    tests = io.tests_by_problem(rows, "l_orderkey", "l_linenumber", "a", "l_returnflag")
    return tests.select("l_orderkey", F.size("tests").cast("bigint").alias("tests"))


@query("SELECT o_orderkey, '{\"o_orderdate\":\"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '\"}' AS json FROM orders")
def s17_stringified(spark: SparkSession, sf: str) -> DataFrame:
    form = "yyyy-MM-dd'T'HH:mm:ss"
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(F.struct("o_orderdate"), {"timestampFormat": form, "timestampNTZFormat": form}).alias("json"))


@query("SELECT event_type, 'step:3 - a/mean:' || printf('%.3f', round(avg(value), 3)) || ' - b:1.000' AS line, round(avg(value), 3) AS back FROM events GROUP BY event_type")
def s21_s22_console(spark: SparkSession, sf: str) -> DataFrame:
    from sievework.operators.metrics import console_line, from_console

    pair = lambda n, v: F.struct(F.lit(n).alias("metric"), v.alias("value"))
    rows = table(spark, sf, "events").groupBy("event_type").agg(F.round(F.avg("value"), 3).alias("a"))
    rows = rows.select("event_type", console_line(F.array(pair("a/mean", F.col("a")), pair("b", F.lit(1.0))), F.lit(3)).alias("line"))
    return rows.select("event_type", "line", from_console(F.col("line"), "a/mean").alias("back"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events WHERE ts IS NOT NULL GROUP BY event_type")
def z2_z6_stream_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A file source read as a stream until it is drained."""
    schema = table(spark, sf, "events").schema.simpleString().removeprefix("struct<").removesuffix(">")
    stream = spark.readStream.schema(table(spark, sf, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf) if schema else None
    grouped = stream.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return flows.drained(grouped, "z2_z6_stream_metrics")
