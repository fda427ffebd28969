"""Row mapping into the canonical training schema, prompts and conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F




def question_mark(q: Column) -> Column:
    q = F.trim(q)
    return F.when(q.endswith("?"), q).otherwise(F.concat(q, F.lit("?")))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def canonical(source: Column, prompt: Column, ability: str, truth: Column, split: str, index: Column, style: str = "rule") -> list[Column]:
    """Columns data_source, prompt, ability, reward_model and extra_info."""
    return [
        source.alias("data_source"), F.array(message("user", prompt)).alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"), F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info"),
    ]


def question_rows(df: DataFrame, source: str, question: str, answer: str, alternatives: str, ook: Column, index: str, template: str, split: str = "train", replace: tuple[str, str] | None = None) -> DataFrame:
    """Question rows: the prompt is ``template`` (with ``{}`` for the question), the target the answer and its
    alternatives. ``replace`` swaps a block of the prompt for another."""
    head, _, tail = template.partition("{}")
    q = question_mark(F.col(question))
    prompt = F.concat(F.lit(head), q, F.lit(tail))
    if replace:
        prompt = F.replace(prompt, F.lit(replace[0]), F.lit(replace[1]))
    truth = F.struct(q.alias("problem"), F.concat(F.array(answer), F.col(alternatives)).alias("target"), ook.alias("out_of_knowledge"))
    return df.select(*canonical(F.lit(source), prompt, "qa", truth, split, F.col(index)))


def mapped(df: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A dataset's own mapping, checked for the canonical columns."""
    out = make(df)
    missing = {"data_source", "prompt", "reward_model"} - set(out.columns)
    if missing:
        raise ValueError(f"columns are missing: {sorted(missing)}")
    return out


def worked_solution(answer: Column) -> Column:
    """The number after ``#### ``, commas dropped; a solution without one is an error."""
    found = F.replace(F.regexp_extract(answer, r"#### (\-?[0-9\.\,]+)", 1), F.lit(","), F.lit(""))
    return F.when(found != "", found).otherwise(F.raise_error(F.lit("no solution")).cast("string"))


def guided_rows(df: DataFrame, source: str, question: str, answer: str, index: str, instruction: str, system: str | None = None, split: str = "train",
                tools: tuple[str, ...] = (), interaction: str | None = None) -> DataFrame:
    """Canonical rows of worked questions: an instruction follows the question, a system message may precede it, and the
    truth is the worked solution. Each tool is created with the truth; an interaction gets its name, the question as
    asked and the truth. Where tools are given, ``need_tools_kwargs`` says so."""
    solution = worked_solution(F.col(answer))
    asked = F.concat(F.col(question), F.lit(" " + instruction))
    info = [F.lit(split).alias("split"), F.col(index).alias("index"), F.col(answer).alias("answer"), F.col(question).alias("question")]
    if tools:
        given = F.struct(F.struct(solution.alias("ground_truth")).alias("create_kwargs"))
        info += [F.lit(True).alias("need_tools_kwargs"), F.struct(*(given.alias(t) for t in tools)).alias("tools_kwargs")]
    if interaction is not None:
        info.append(F.struct(F.lit(interaction).alias("name"), asked.alias("query"), solution.alias("ground_truth")).alias("interaction_kwargs"))
    return df.select(
        F.lit(source).alias("data_source"), conversation(F.lit(system).cast("string"), asked).alias("prompt"), F.lit("math").alias("ability"),
        F.struct(F.lit("rule").alias("style"), solution.alias("ground_truth")).alias("reward_model"), F.struct(*info).alias("extra_info"))


def references(docs: Column, k: int) -> Column:
    """``Doc i(Title: ...) text`` lines of the first ``k`` (title, text)."""
    line = lambda d, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), d["title"], F.lit(") "), d["text"], F.lit("\n"))
    return F.array_join(F.transform(F.slice(docs, 1, k), line), "")


def budgeted_references(refs: Column, most: int) -> Column:
    """Numbered references in order, up to the first that would exceed ``most`` characters in all; it stops there."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("i"), F.lit(False).alias("stop"), F.lit("").alias("out"))

    def step(a: Column, r: Column) -> Column:
        full = a["stop"] | (a["n"] + F.length(r) > most)
        line = F.concat(F.lit("# Reference "), (a["i"] + 1).cast("string"), F.lit("\n"), r, F.lit("\n"))
        return F.struct(
            F.when(full, a["n"]).otherwise(a["n"] + F.length(r)).alias("n"), F.when(full, a["i"]).otherwise(a["i"] + 1).alias("i"),
            full.alias("stop"), F.when(full, a["out"]).otherwise(F.concat(a["out"], line)).alias("out"))

    return F.aggregate(refs, start, step, lambda a: a["out"])


def fitted_prompt(prompt: Column, completion: Column, most: int) -> Column:
    """The prompt's head, shortened so that prompt and completion have ``most`` tokens together."""
    return F.slice(prompt, F.lit(1), F.greatest(F.lit(0), F.least(F.size(prompt), most - F.size(completion))))


def conversation(system: Column, user: Column) -> Column:
    """A system message where there is one, and the user's."""
    return F.array_compact(F.array(F.when(system.isNotNull() & (system != ""), message("system", system)), message("user", user)))


def segments(content: Column, marks: tuple[str, ...] = ("<image>", "<video>")) -> Column:
    """Content cut at placeholders into (type, text), without empty pieces."""
    pattern = "|".join(marks)
    pieces = F.filter(F.split(content, f"(?=({pattern}))|(?<=({pattern}))"), lambda p: p != "")
    kind = lambda p: F.when(p.isin(*marks), F.regexp_replace(p, "[<>]", "")).otherwise(F.lit("text"))
    return F.transform(pieces, lambda p: F.struct(kind(p).alias("type"), F.when(p.isin(*marks), F.lit("")).otherwise(p).alias("text")))


def unpivoted_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str) -> DataFrame:
    """A row for each of the chosen and the rejected response."""
    return df.select(prompt, F.explode(F.array(chosen, rejected)).alias("response"))


def positional_split(rows: DataFrame, share: float) -> DataFrame:
    """``split`` by position: the first ``share`` of the rows train, the rest test."""
    n = rows.count()
    return rows.withColumn("split", F.when(F.col("row_id") < int(n * share), "train").otherwise("test"))


def shuffled_choices(row_id: Column, right: Column, wrong: Column, seed: int) -> Column:
    """Wrong choices in a seeded order with the right one at a seeded place: (choices, answer letter)."""
    order = F.transform(F.array_sort(F.transform(wrong, lambda w, i: F.struct(F.xxhash64(row_id, F.lit(seed), i).alias("h"), w.alias("w")))), lambda x: x["w"])
    at = F.pmod(F.xxhash64(row_id, F.lit(seed), F.lit("place")), F.lit(4)).cast("int")
    choices = F.concat(F.slice(order, F.lit(1), at), F.array(right), F.slice(order, at + 1, F.lit(3)))
    return F.struct(choices.alias("choices"), F.substring(F.lit("ABCD"), at + 1, F.lit(1)).alias("answer"))


def code_turns(text: Column) -> Column:
    """Alternating assistant and tool messages of a text with ``<code>`` and ``<interpreter>`` blocks; an ``<answer>``
    block stays with the last assistant message."""
    parts = F.split(text, r"(?=<interpreter>)|(?<=</interpreter>)")
    tool = lambda p: p.startswith("<interpreter>")
    made = F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.struct(
        F.when(tool(p), "tool").otherwise("assistant").alias("role"), F.trim(F.regexp_replace(p, "</?interpreter>", "")).alias("content")))
    return made


def with_includes(code: Column, headers: list[str]) -> Column:
    out = code
    for h in reversed(headers):
        out = F.when(F.contains(out, F.lit(h)), out).otherwise(F.concat(F.lit(h + "\n"), out))
    return out


def print_wrapped(code: Column) -> Column:
    """The last line that isn't blank in ``print(...)``, unless it prints already."""
    lines = F.split(code, "\n")
    last = F.aggregate(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i).otherwise(-1)), F.lit(-1), lambda a, x: F.greatest(a, x))
    wrap = lambda x, i: F.when((i == last) & ~F.ltrim(x).startswith("print"), F.concat(F.lit("print("), x, F.lit(")"))).otherwise(x)
    return F.array_join(F.transform(lines, wrap), "\n")


def alternatives(text: Column) -> Column:
    """A list in quotes, a bare string, or nothing, as an array of strings."""
    parsed = F.from_json(F.replace(text, F.lit("'"), F.lit('"')), "array<string>")
    return F.when(text.isNull() | (F.trim(text) == ""), F.array().cast("array<string>")).when(F.trim(text).startswith("["), F.coalesce(parsed, F.array(text))).otherwise(F.array(text))


def loss_mask(messages: Column) -> Column:
    """Per word 1 for assistant messages, else 0."""
    return F.flatten(F.transform(messages, lambda m: F.array_repeat(F.when(m["role"] == "assistant", 1).otherwise(0), F.size(F.split(m["content"], " ")))))


def tool_result(text: Column) -> Column:
    """Of a tool's reply the first query, the number of titles and the first result list."""
    plain = F.replace(text, F.lit("'"), F.lit('"'))
    return F.struct(
        F.regexp_extract(plain, r'"query"\s*:\s*"([^"]*)"', 1).alias("query"), F.regexp_count(plain, F.lit(r'"title"\s*:')).alias("titles"),
        F.regexp_extract(plain, r'(?s)"results"\s*:\s*(\[.*?\])', 1).alias("results"))


def letter_counts(n: Column, word: Column, letter: Column) -> Column:
    """A letter-count question with its worked answer, numbered by ``n``: prompt, response and count."""
    chars = F.filter(F.split(word, ""), lambda c: c != "")
    lines = F.transform(chars, lambda c, i: F.concat(c, F.when(c == letter, F.lit(" = ")).otherwise(F.lit(" != ")), letter))
    count = F.size(F.filter(chars, lambda c: c == letter))
    return F.struct(F.concat(F.lit("How many "), letter, F.lit(" are there in word "), word, F.lit("?")).alias("prompt"), F.concat(F.array_join(lines, "\n"), F.lit("\n\\boxed{"), count.cast("string"), F.lit("}")).alias("response"), count.alias("count"))


