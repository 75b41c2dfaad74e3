"""The second dialect, where its rules differ: matching, chunking, rules, extraction and display width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import chunkers, rules, scorers


def normalize_for_match(text: Column) -> Column:
    """Only ASCII white space goes."""
    return F.lower(F.regexp_replace(T.normalize_text(text), r"\s+", ""))


def faithfulness(context: Column, answer: Column) -> Column:
    """Numbers as they stand: months, dates and scales are not converted."""
    lost = T.unsupported_numbers(T.extract_numbers(answer), T.bounded_numbers(T.normalize_text(context)))
    return F.struct(F.lit(None).cast("double").alias("score"), (F.size(lost) == 0).alias("passed"), F.transform(lost, lambda n: F.concat(n["value"], F.when(n["pct"], "%").otherwise(""))).alias("details"))


def case_passed(recall: Column, complete: Column, faithful: Column) -> Column:
    """No gate of required entities."""
    return scorers.case_passed(recall, complete, faithful)


def recursive_chunks(docs: DataFrame, size: int = 400, overlap: int = 60, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Paragraphs are trimmed; chunks that repeat stay; sizes are checked."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap smaller than it")
    trimmed = F.array_join(F.filter(F.transform(F.split(text_col, "\n\n"), lambda p: F.trim(p)), lambda p: F.length(p) > 0), "\n\n")
    packed = docs.select(id_col, chunkers.packed_paragraphs(trimmed, size).alias("packed"))
    tail = F.transform("packed", lambda c, i: F.concat(F.when(i > 0, F.right(F.get("packed", i - 1), F.lit(overlap))).otherwise(""), c))
    at = packed.select(F.col(id_col).alias("doc_id"), F.posexplode(tail).alias("idx", "content"))
    return at.select(F.concat(F.col("doc_id").cast("string"), F.lit("_c"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", "content")


def table_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Empty cells stay, and blank rows count in the index."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("idx", "row")).where(F.trim("row") != "")
    cells = F.transform(F.split("row", "[,，\t]"), lambda c: F.trim(c))
    told = F.when(F.size(cells) >= 2, F.concat(F.get(cells, F.lit(0)), F.lit("为"), F.array_join(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(1))), "，"))).otherwise(F.col("row"))
    return rows.select(F.concat(F.col("doc_id").cast("string"), F.lit("_f"), F.col("idx").cast("string")).alias("chunk_id"), "doc_id", "idx", told.alias("content"))


def numeric_rule(fact: Column, context: Column) -> Column:
    """A number counts if it stands in the context or an amount equals the fact's."""
    lost = T.unsupported_numbers(T.extract_numbers(fact["object_value"]), T.bounded_numbers(T.normalize_text(context)))
    same = F.size(rules.unit_rule(fact, context)) == 0
    return rules.when((F.size(lost) > 0) & ~same, rules.finding("UNSUPPORTED_NUMBER", "object_value", F.concat(F.lit("数值 "), fact["object_value"], F.lit(" 在上下文中无出处"))))


def matrix() -> rules.RuleMatrix:
    out = rules.RuleMatrix()
    out.by_type |= {"numeric": numeric_rule, "entity_rel": rules.relation_rule_java}
    return out


def fact_type(text: Column) -> Column:
    """Unknown names are numeric."""
    return F.when(F.lower(text).isin("numeric", "entity_rel", "condition", "categorical"), F.lower(text)).otherwise("numeric")


def extract(context: Column) -> Column:
    """Facts: number spans; for each negation word its first place with what stands around it; condition words likewise."""
    norm = T.normalize_text(context)
    make = lambda s, p, o, kind, neg: F.struct(s.alias("subject"), p.alias("predicate"), o.alias("object_value"), F.lit(kind).alias("fact_type"), F.lit(neg).alias("is_negative"), o.alias("source_text"))
    numbers = F.transform(T.number_spans(norm), lambda s: make(F.lit(""), F.lit("数值"), F.trim(s["raw"]), "numeric", False))

    def around(word: Column, kind: str, neg: bool, after: int) -> Column:
        at = F.call_function("instr", norm, word)
        before = F.call_function("substring", norm, F.greatest(at - 10, F.lit(1)), F.least(at - 1, F.lit(10)))
        rest = F.call_function("substring", norm, at + F.char_length(word), F.lit(after))
        runs = lambda c, end: F.regexp_extract(c, r"([\x{4e00}-\x{9fff}]{2,6})" + end, 1)
        return make(runs(before, "$") if neg else F.lit(""), word, runs(rest, "") if neg else rest, kind, neg)

    found = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(norm, w))
    negated = F.transform(found(T.NEGATION_WORDS), lambda w: around(w, "entity_rel", True, 10))
    bound = F.transform(found(T.CONDITION_KEYWORDS), lambda w: around(w, "condition", False, 20))
    return F.concat(numbers, F.filter(negated, lambda f: (F.length(f["subject"]) > 0) & (F.length(f["object_value"]) > 0)), bound)


def display_width(text: str) -> int:
    """Only characters of the CJK blocks are wide."""
    return sum(2 if 0x2E80 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF or 0xFF00 <= ord(c) <= 0xFF60 else 1 for c in text)
