"""Queries: answer extraction, normalisation and rewards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions import text as T
from sievework.operators import rewards as R
from sievework.plans.standins import RESPONSES, responses, sql_normal, table

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {sql_normal('text')} AS normal FROM documents")
def x1_normalize_answer(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.normalize_answer(F.col("text")).alias("normal"))


@query(f"WITH {RESPONSES} SELECT doc_id, answer FROM p")
def x2_extract_answer(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("doc_id", T.boxed_or_tagged(F.col("response")).alias("answer"))


_ANY = f"len(list_filter(target, lambda g: {sql_normal('g')} = {sql_normal('answer')})) > 0"
_SUB = f"len(list_filter(target, lambda g: contains({sql_normal('answer')}, {sql_normal('g')}))) > 0"


@query(f"WITH {RESPONSES} SELECT doc_id, CASE WHEN answer IS NULL THEN NULL ELSE {_ANY} END AS em, CASE WHEN answer IS NULL THEN NULL ELSE {_SUB} END AS subem FROM p")
def x3_x4_em_checks(spark: SparkSession, sf: str) -> DataFrame:
    answer = T.boxed_or_tagged(F.col("response"))
    return responses(spark, sf).select("doc_id", T.exact_match(answer, F.col("target")).alias("em"), T.contains_match(answer, F.col("target")).alias("subem"))


@query(f"WITH {RESPONSES} SELECT doc_id, (len(string_split(response, '<answer>')) + len(string_split(response, '</answer>')) - 2)::INT AS tags FROM r")
def x5_answer_tags(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("doc_id", T.answer_tags(F.col("response")).alias("tags"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 < 2 THEN doc_id % 4 ELSE -1 END AS score, CASE WHEN doc_id % 4 < 3 THEN 'because ' || source ELSE '' END AS explanation FROM documents""")
def x6_judge_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Replies with two blocks, a score of 2, or neither score nor explanation."""
    last = F.when(F.col("doc_id") % 4 == 3, F.lit("{}")).otherwise(F.concat(F.lit('{"score": '), (F.col("doc_id") % 4).cast("string"), F.lit(', "explanation": "because '), F.col("source"), F.lit('"}')))
    reply = F.concat(F.lit('first {"score": 0} and then '), last)
    return table(spark, sf, "documents").select("doc_id", T.judge_verdict(reply).alias("v")).select("doc_id", F.col("v.score").cast("bigint").alias("score"), "v.explanation")


@query("SELECT doc_id, regexp_replace(trim(lower(text)), '\\s+', ' ', 'g') AS normal FROM documents")
def x7_normalize_string(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_string(F.col("text")).alias("normal"))


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), ' ') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 8 THEN list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' ')) ELSE [] END) AS g FROM w)
SELECT doc_id, count(*) AS grams, count(DISTINCT g) AS distinct_grams FROM g GROUP BY doc_id""")
def x8_x9_word_ngrams(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split(T.normalize_string(F.col("text")), " ")
    grams = table(spark, sf, "documents").select("doc_id", T.word_ngrams(words, 8).alias("g")).where("size(g) > 0")
    return grams.select("doc_id", F.size("g").cast("bigint").alias("grams"), F.size(F.array_distinct("g")).cast("bigint").alias("distinct_grams"))


@query("""WITH r AS (SELECT doc_id, 'so it is ' || n_chars || ' and #### ' || CASE WHEN doc_id % 3 = 0 THEN '1,' || (100 + doc_id % 800) ELSE doc_id::VARCHAR END || CASE WHEN doc_id % 2 = 0 THEN ' or 7' ELSE '' END AS r FROM documents)
SELECT doc_id, replace(regexp_extract(r, '#### (-?[0-9.,]+)', 1), ',', '') AS strict, CASE WHEN doc_id % 2 = 0 THEN '7' ELSE regexp_extract(r, '#### (-?[0-9.,]+)', 1) END AS flexible,
  CASE WHEN doc_id % 3 = 0 THEN 0.2 ELSE 1.0 END::DOUBLE AS reward FROM r""")
def x21_r10_gsm8k(spark: SparkSession, sf: str) -> DataFrame:
    number = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("1,"), (F.col("doc_id") % 800 + 100).cast("string"))).otherwise(F.col("doc_id").cast("string"))
    more = F.when(F.col("doc_id") % 2 == 0, F.lit(" or 7")).otherwise(F.lit(""))
    reply = F.concat(F.lit("so it is "), F.col("n_chars").cast("string"), F.lit(" and #### "), number, more)
    return table(spark, sf, "documents").select("doc_id", T.gsm8k_answer(reply, True).alias("strict"), T.gsm8k_answer(reply, False).alias("flexible"), R.gsm8k(reply, F.col("doc_id").cast("string"), True, 0.2).alias("reward"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN substr('ABCDEF', (doc_id % 3)::INT + 1, 1) END AS choice, CASE doc_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'b' ELSE '[INVALID]' END AS minerva FROM documents""")
def x19_x26_choices(spark: SparkSession, sf: str) -> DataFrame:
    reply = F.when(F.col("doc_id") % 3 == 0, F.lit("Answer: A")).when(F.col("doc_id") % 3 == 1, F.lit("I say\nanswer: b")).otherwise(F.lit("nothing"))
    return table(spark, sf, "documents").select("doc_id", T.choice_letter(reply).alias("choice"), T.minerva_answer(reply).alias("minerva"))


@query("SELECT doc_id, md5(doc_id::VARCHAR) AS id_md5, md5(text) AS text_md5 FROM documents")
def x27_md5(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.col("doc_id").cast("string")).alias("id_md5"), F.md5("text").alias("text_md5"))


_N = sql_normal("answer")
_IDK, _BAD = f"contains({_N}, 'i dont know')", f"contains({_N}, 'invalid question')"
_HIT = f"({_ANY} OR list_contains(judge, 1))"


def _ladder(hit: str, right: str = "1.0", abstain: str = "0.0", ook: str = "") -> str:
    return f"CASE WHEN answer IS NULL THEN -1.0 {ook} WHEN {_IDK} THEN {abstain} WHEN {_BAD} THEN -1.0 WHEN {hit} THEN {right} ELSE -1.0 END::DOUBLE"


@query(f"""WITH {RESPONSES} SELECT doc_id, {_ladder(_HIT)} AS ternary, {_ladder(_ANY)} AS ternary_em, {_ladder(_HIT, ook=f'WHEN ook AND {_IDK} THEN 1.0 WHEN ook THEN -1.0')} AS ternary_ook,
  {_ladder(_HIT, right='2.0')} AS ternary_double, {_ladder(_HIT, abstain='-1.0')} AS binary_, CASE WHEN answer IS NOT NULL AND ook AND {_IDK} THEN 1.0 ELSE {_ladder(_HIT, abstain='-1.0')} END::DOUBLE AS binary_ook FROM p""")
def r1_r8_answer_ladders(spark: SparkSession, sf: str) -> DataFrame:
    """R1 to R5 and R8."""
    a = (F.col("response"), F.col("target"))
    judge, ook = F.col("judge"), F.col("ook")
    return responses(spark, sf).select(
        "doc_id", R.ternary(*a, judge).alias("ternary"), R.ternary_em(*a).alias("ternary_em"), R.ternary_ook(*a, judge, ook).alias("ternary_ook"),
        R.ternary_double(*a, judge).alias("ternary_double"), R.binary(*a, judge).alias("binary_"), R.binary_ook(*a, judge, ook).alias("binary_ook"))


@query(f"WITH {RESPONSES} SELECT doc_id, CASE WHEN answer IS NULL THEN 0.0 WHEN {_ANY} THEN 1.0 ELSE 0.1 END::DOUBLE AS em, CASE WHEN answer IS NULL THEN 0.0 WHEN {_SUB} THEN 1.0 ELSE 0.0 END::DOUBLE AS subem FROM p")
def r7_qa_em(spark: SparkSession, sf: str) -> DataFrame:
    a = (F.col("response"), F.col("target"))
    return responses(spark, sf).select("doc_id", R.qa_em(*a, format_score=0.1).alias("em"), R.qa_em(*a, substring=True).alias("subem"))


@query(f"""WITH {RESPONSES}, e AS (SELECT *, {sql_normal('answer')} AS n, {sql_normal('target[1]')} AS g1, {sql_normal('target[2]')} AS g2 FROM p)
SELECT doc_id, CASE WHEN answer IS NULL THEN -1 WHEN contains(n, 'i dont know') THEN 0 WHEN n = g1 THEN 1 WHEN contains(lower(answer), 'invalid question') THEN CASE WHEN n = g2 THEN 1 ELSE -1 END
  WHEN judge[1] = 1 THEN 1 WHEN n = g2 THEN 1 WHEN judge[2] = 1 THEN 1 ELSE -1 END AS score FROM e""")
def r36_evaluation_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("doc_id", R.judged_evaluation(T.boxed_or_tagged(F.col("response")), F.col("target"), F.col("judge")).alias("score"))


@query("""WITH t AS (SELECT doc_id, source, len(string_split(text, ' ')) AS n, doc_id % 2 = 0 AS ok, text FROM documents)
SELECT doc_id, round(CASE WHEN ok THEN 0.5 + 0.25 * (1 + cos(n / 400.0 * pi())) ELSE -0.5 - 0.25 * (1 + cos(n / 400.0 * pi())) END, 6) AS cosine,
  CASE WHEN n <= 80 THEN 0.0 WHEN n <= 400 THEN (80 - n) / 320.0 ELSE -1.0 END AS overlong, least(-(n - 80) / 320.0 * 1.5, 0.0) AS penalty FROM t""")
def r22_r24_r29_length_rewards(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.split("text", " "))
    return table(spark, sf, "documents").select(
        "doc_id", F.round(T.cosine_reward(F.col("doc_id") % 2 == 0, n, 400), 6).alias("cosine"), T.soft_overlong(n, 400, 320).alias("overlong"), T.overlong_penalty(n, 400, 320, 1.5).alias("penalty"))


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) ELSE [] END AS g FROM w)
SELECT doc_id, round(CASE WHEN len(w) < 3 THEN 0.0 ELSE (1.0 - len(list_distinct(g)) / len(g)) * -0.5 END, 6) AS reward FROM g""")
def r23_repetition_penalty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.round(T.repetition_penalty(F.col("text"), 3, -0.5), 6).alias("reward"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS format, CASE doc_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS tags, CASE doc_id % 3 WHEN 0 THEN 2 / 3.0 WHEN 1 THEN 0.0 ELSE 1.0 END AS steps FROM documents""")
def r18_r20_format_rewards(spark: SparkSession, sf: str) -> DataFrame:
    reply = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<think>\nFirst, Finally,"), F.col("source"), F.lit("\n</think>\n<answer>\n1\n</answer>")))
        .when(F.col("doc_id") % 3 == 1, F.lit("<think>\nx\n</think>\n")).otherwise(F.lit("Step 1: a\nStep 2: b\n- c\n* d"))
    )
    return table(spark, sf, "documents").select("doc_id", T.format_reward(reply).alias("format"), T.tag_count_reward(reply).alias("tags"), T.reasoning_steps_reward(reply).alias("steps"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'b = ' || doc_id ELSE '' END || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END AS code, '' AS none,
  CASE WHEN doc_id % 2 = 0 THEN 'say  now' ELSE 'say nothing' END AS content, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS calls FROM documents""")
def p24_p26_code_and_tools(spark: SparkSession, sf: str) -> DataFrame:
    even, doc = F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")
    code = F.when(even, F.concat(F.lit("```python\na = 1\n```\n```python\nb = "), doc, F.lit("\n```"))).otherwise(F.lit("```cpp\nx\n```"))
    call = F.when(even, F.lit('say <tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call> now<tool_call>{bad</tool_call>')).otherwise(F.lit("say nothing"))
    return table(spark, sf, "documents").select("doc_id", T.fenced_code(code, "python").alias("code"), T.fenced_code(code, None).alias("none"), T.tool_calls(call).alias("t")).select("doc_id", "code", "none", F.col("t.content").alias("content"), F.size("t.calls").alias("calls"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 40) || '...(truncated)' END AS l, CASE WHEN length(text) <= 40 THEN text ELSE '(truncated)...' || right(text, 40) END AS r,
  CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 20) || '...(truncated)...' || right(text, 20) END AS m FROM documents""")
def p27_tool_truncation(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", *(T.truncate_sides(F.col("text"), 40, s).alias(s[0]) for s in ("left", "right", "middle")))


R.register_scorer("src1", lambda r, g: R.ternary_em(r, g))
R.register_scorer("src2", lambda r, g: R.qa_em(r, g))


@query(f"WITH {RESPONSES} SELECT doc_id, CASE WHEN starts_with(source, 'src1') THEN {_ladder(_ANY)} WHEN starts_with(source, 'src2') THEN CASE WHEN answer IS NOT NULL AND {_ANY} THEN 1.0 ELSE 0.0 END END::DOUBLE AS score FROM p")
def x28_score_by_source(spark: SparkSession, sf: str) -> DataFrame:
    return responses(spark, sf).select("doc_id", R.score_by_source(F.col("source"), F.col("response"), F.col("target")).alias("score"))
