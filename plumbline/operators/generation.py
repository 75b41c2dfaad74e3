"""Generation as tables: prompts out, answers in; candidate payloads go through the states of constrained decoding."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import coerce, facts
from plumbline.operators import rules as R

#: Prompts, with a place for each column by its name. They ask for what the parsers below read; others can be given.
EXTRACTION = "从材料中摘出回答问题所需的事实，逐字照录，不得改写或补充。以 JSON 作答：{{\"facts\": [{{\"key\", \"value\", \"sourceText\", \"isNumeric\"}}], \"claims\": []}}\n问题：{question}\n材料：{context}"
JUDGEMENT = "材料是否支持陈述？只回答一个字母：A 支持，B 矛盾，C 未提及。\n材料：{context}\n陈述：{claim}"
REALIZATION = "把下列已核实的事实连成一段话，不得增加任何数字、日期、机构或条件。\n事实：{facts}\n问题：{question}"


def prompts(df: DataFrame, template: str) -> DataFrame:
    """``df`` with ``prompt``: the template with each ``{column}`` filled in; arrays and structs as JSON. Null is empty."""
    plain = dict(df.dtypes)
    absent = {name for _, name, _, _ in string.Formatter().parse(template) if name} - set(plain)
    if absent:
        raise ValueError(f"the table lacks {sorted(absent)}")
    value = lambda c: F.coalesce(F.col(c).cast("string") if not plain[c].startswith(("array", "struct", "map")) else F.to_json(c), F.lit(""))
    parts = [x for text, name, _, _ in string.Formatter().parse(template) for x in ([F.lit(text)] if text else []) + ([value(name)] if name else [])]
    return df.withColumn("prompt", F.concat(*parts))


def judge_class(answer: Column, by_prefix: bool = False) -> Column:
    """A, B or C (supported, contradicted, not mentioned) of a judge's answer; whatever else it says, or nothing, is C."""
    said = F.upper(F.regexp_replace(answer, r"(?U)^\s+|\s+$", ""))
    letter = F.substring(said, 1, 1) if by_prefix else said
    return F.when(letter.isin("A", "B", "C"), letter).otherwise("C")


def judge_accepts(answer: Column, by_prefix: bool = False) -> Column:
    return judge_class(answer, by_prefix) == "A"


def chat_request(prompt: Column, model: str, temperature: float = 0.0, num_predict: int = 800) -> Column:
    """The JSON body of a chat request."""
    head = F.lit('{"model":"'), T.json_escaped(F.lit(model)), F.lit('","stream":false,"messages":[{"role":"user","content":"')
    return F.concat(*head, T.json_escaped(prompt), F.lit(f'"}}],"options":{{"temperature":{temperature},"num_predict":{num_predict}}}}}'))


def chat_answer(body: Column) -> Column:
    """The message of a chat response's JSON body, trimmed; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.get_json_object(body, "$.message.content"), r"(?U)^\s+|\s+$", ""), F.lit(""))


_FACT = r'(?i)\{[^{}]*"key"\s*:\s*"([^"]+)"[^{}]*"value"\s*:\s*"([^"]+)"[^{}]*"sourceText"\s*:\s*"([^"]*)"[^{}]*"isNumeric"\s*:\s*(true|false)[^{}]*\}'


def answered_facts(answer: Column) -> Column:
    """Array of (key, value, source_text, is_numeric): the complete facts of an extractor's answer, broken JSON or not."""
    plain = F.trim(T.strip_code_fence(answer))
    key, value, source, numeric = (F.regexp_extract_all(plain, F.lit(_FACT), F.lit(i)) for i in range(1, 5))
    return F.transform(
        F.arrays_zip(key.alias("k"), value.alias("v"), source.alias("s"), numeric.alias("n")),
        lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"), x["s"].alias("source_text"), (F.lower(x["n"]) == "true").alias("is_numeric")),
    )


def answered_claims(answer: Column) -> Column:
    """The strings of an answer's list of claims."""
    return F.regexp_extract_all(F.regexp_extract(answer, r'"claims"\s*:\s*\[([^\]]*)\]', 1), F.lit(r'"([^"]+)"'), F.lit(1))


def _with_payload(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn("_p", coerce.coerce_payload(F.col(column))).withColumns({"atomic_facts": F.col("_p.atomic_facts"), "facts": F.col("_p.facts"), "_violations": F.col("_p.violations")}).drop("_p")


def decode(df: DataFrame, payload: str = "payload", repair: str | None = None, context: str = "context", matrix: R.RuleMatrix | None = None) -> DataFrame:
    """``df`` (id, context, payload, maybe a repaired payload) with the outcome of constrained decoding.

    Adds atomic_facts, facts, findings, accepted, trace, repair_count, schema_violations. A payload is coerced, checked,
    and accepted or, if it fails, its repair (not null) is checked in its place, once; a row without one is rejected.
    Only rows that fail the first check meet the second. The trace is held against the legal moves.
    """
    rows = df if "expected_entities" in df.columns else df.withColumn("expected_entities", F.array().cast("array<string>"))
    first = facts.verify(_with_payload(rows, payload), context, matrix).withColumnRenamed("_violations", "schema_violations")
    again = F.col(repair).isNotNull() if repair else F.lit(False)
    settled = first.where(F.col("verified") | ~again).withColumn("repair_count", F.lit(0))
    out = settled
    if repair:
        second = first.where(~F.col("verified") & again).drop("findings", "verified", "atomic_facts", "facts")
        second = facts.verify(_with_payload(second, repair).drop("_violations"), context, matrix).withColumn("repair_count", F.lit(1))
        out = settled.unionByName(second.select(settled.columns))
    trace = facts.state_trace(F.col("verified"), F.col("repair_count") > 0, F.col("verified"))
    checked = F.when(facts.legal_trace(trace), trace).otherwise(F.raise_error(F.lit("a state was left by a move that is not allowed")))
    out = out.withColumn("trace", checked).withColumnRenamed("verified", "accepted")
    return out if "expected_entities" in df.columns else out.drop("expected_entities")
