"""Dataset audit, failure attribution and the quality baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import bm25, chunkers, facts, retrieval, runner, scorers

_NO_STRINGS = "array<string>"


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def conflicting(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct value."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("versions")).where("versions > 1")


def issues(samples: DataFrame) -> DataFrame:
    """(code, subject): every violation; subject is the sample, question or source."""
    gold, answer = F.col("ground_truth_context"), F.col("ground_truth_answer")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    valid = (
        scorers.completeness(F.col("expected_entities"), answer, 1.0)["passed"]
        & scorers.faithfulness(gold, answer)["passed"]
        & scorers.required_entities(F.coalesce("required_entities", F.array().cast(_NO_STRINGS)), answer)["passed"]
    )
    row_codes = F.array_compact(
        F.array(
            F.when(blank(F.col("source_id")), "missing_source"),
            F.when(blank(F.col("question")) | blank(gold) | blank(answer), "empty_required_text"),
            F.when(~valid, "invalid_gold"),
            F.when((F.col("category") == "adversarial") & (blank(F.col("candidate_answer")) | (F.col("candidate_answer") == answer)), "ineffective_mutation"),
        )
    )
    by_row = samples.select(F.explode(row_codes).alias("code"), F.col("id").alias("subject"))
    twice = duplicate_keys(samples, "id").select(F.lit("duplicate_id").alias("code"), F.col("id").alias("subject"))
    vague = conflicting(samples, "question", "ground_truth_context").select(F.lit("ambiguous_question").alias("code"), F.col("question").alias("subject"))
    clash = conflicting(samples, "source_id", "ground_truth_context").select(F.lit("conflicting_source").alias("code"), F.col("source_id").alias("subject"))
    return by_row.unionByName(twice).unionByName(vague).unionByName(clash)


def classify_failure(data_invalid: Column, source_hit: Column, oracle_passed: Column, actual_passed: Column, gold_supported: Column) -> Column:
    return (
        F.when(data_invalid, "data")
        .when(~source_hit, "retrieval_source_miss")
        .when(~oracle_passed, "generation_with_gold_context")
        .when(~gold_supported, "context_contamination")
        .when(~actual_passed, "generation_with_retrieved_context")
        .otherwise("pass")
    )


def checked_sources(samples: DataFrame, source: str = "source", text: str = "ground_truth_context") -> DataFrame:
    """(source, text): each source once; a source with two texts is an error, which names the first such source."""
    versions = samples.groupBy(F.col(source).alias("source")).agg(F.min(text).alias("text"), F.max(text).alias("_last"))
    clash = F.concat(F.lit("a source has different texts: "), F.col("source"))
    return versions.select("source", F.when(F.col("text") == F.col("_last"), F.col("text")).when(F.col("text").isNull(), F.col("text")).otherwise(F.raise_error(clash)).alias("text"))


def copies(df: DataFrame, id_col: str, text: str, source: str) -> DataFrame:
    """(text_md5, copies, sources, first): texts that several rows have, and from how many sources."""
    hashed = df.where(F.col(text).isNotNull()).select(F.md5(text).alias("text_md5"), F.col(source).alias("_source"), F.col(id_col).alias("_id"))
    several = duplicate_keys(hashed, "text_md5")
    spread = hashed.groupBy("text_md5").agg(F.count_distinct("_source").alias("sources"), F.min("_id").alias("first"))
    return several.join(spread, "text_md5").select("text_md5", F.col("n").alias("copies"), "sources", "first")


def source_chunks(samples: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """Chunks of each distinct source, stamped with the one source that its text names, in order of first appearance."""
    own = samples.withColumn("source", F.coalesce("source_id", "id"))
    docs = checked_sources(own).join(own.groupBy("source").agg(F.min("ordinal").alias("at")), "source")
    named = docs.withColumn("marks", T.source_markers(F.col("text"))).select("source", "at", F.when(F.size("marks") == 1, F.get("marks", F.lit(0))).alias("scope_id"))
    cut = chunkers.recursive_chunks(docs, size, overlap, "source", "text").withColumnRenamed("doc_id", "source")
    return cut.join(named, "source").withColumn("doc", F.struct("at", "idx", "chunk_id"))


def baseline(samples: DataFrame, top_k: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, adversarial, summary) of samples that carry an ``ordinal``; the audit comes before, see ``issues``.

    Retrieval sees questions only. The actual run answers from the scoped retrieved context, the control run from the
    gold context; both go through the controlled pipeline and the same scorers.
    """
    chunks = source_chunks(samples).persist()
    index = bm25.fit(chunks, "doc", "content")
    asked = samples.select(F.col("id").alias("query_id"), F.col("question").alias("query"))
    hits = bm25.search(index, asked, top_k, text_col="query").join(chunks.select("doc", "content", "chunk_id", "scope_id", F.col("source").alias("doc_id")), "doc").persist()
    scoped = retrieval.select_context(hits, asked.withColumn("sources", F.lit(None).cast(_NO_STRINGS)))
    retrieved = hits.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("retrieved_sources"))
    joined = samples.join(scoped.withColumnRenamed("query_id", "id"), "id").join(retrieved.withColumnRenamed("query_id", "id"), "id", "left")
    runs = joined.withColumn("run", F.explode(F.array(F.lit("actual"), F.lit("oracle")))).withColumn("context", F.when(F.col("run") == "oracle", F.col("ground_truth_context")).otherwise(F.col("context")))
    answered = facts.run_pipeline(runs).withColumn("answer", F.when((F.col("run") == "actual") & F.col("error_code").isNotNull(), "").otherwise(F.col("answer")))
    scored = answered.select(
        "id", "category", "ordinal", "run", "source_id", "retrieved_sources",
        (scorers.context_recall(F.col("ground_truth_context"), F.col("context"))["score"]).alias("recall"),
        (scorers.completeness(F.col("expected_entities"), F.col("answer"))["score"]).alias("complete"),
        (scorers.faithfulness(F.col("context"), F.col("answer"))["passed"] & ((F.col("run") == "oracle") | F.col("error_code").isNull())).alias("faithful"),
        scorers.required_entities(F.coalesce("required_entities", F.array().cast(_NO_STRINGS)), F.col("answer"))["passed"].alias("required"),
        scorers.faithfulness(F.col("ground_truth_context"), F.col("answer"))["passed"].alias("gold_supported"),
    )
    scored = scored.withColumn("passed", scorers.case_passed(F.col("recall"), F.col("complete"), F.col("faithful"), F.col("required")))
    of = lambda run, c: F.max(F.when(F.col("run") == run, F.col(c)))
    cases = scored.groupBy("id", "category", "ordinal", "source_id").agg(
        F.first("retrieved_sources").alias("retrieved_sources"), of("actual", "recall").alias("context_recall"), of("actual", "complete").alias("completeness"), of("actual", "faithful").alias("faithful"),
        of("actual", "passed").alias("metric_passed"), of("oracle", "passed").alias("oracle_passed"), of("actual", "gold_supported").alias("gold_numeric_supported"),
    )
    cases = cases.withColumn("source_hit", F.coalesce(F.array_contains("retrieved_sources", F.col("source_id")), F.lit(False)))
    cases = cases.withColumn("classification", classify_failure(F.lit(False), F.col("source_hit"), F.col("oracle_passed"), F.col("metric_passed"), F.col("gold_numeric_supported")))
    candidate, gold = F.col("candidate_answer"), F.col("ground_truth_context")
    ok = scorers.completeness(F.col("expected_entities"), candidate)["passed"] & scorers.faithfulness(gold, candidate)["passed"]
    gate = scorers.required_entities(F.coalesce("required_entities", F.array().cast(_NO_STRINGS)), candidate)["passed"]
    adversarial = samples.where(candidate.isNotNull()).select("id", "mutation_type", (~(ok & gate)).alias("detected"), (~ok).alias("legacy_detected"))
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 4)
    summary = cases.agg(
        F.count("*").alias("total"), F.round(F.avg("context_recall"), 4).alias("context_recall"), F.round(F.avg("completeness"), 4).alias("completeness"), rate("faithful").alias("faithfulness"), rate("metric_passed").alias("case_pass_rate"),
        rate("source_hit").alias("source_hit_rate"), rate("oracle_passed").alias("oracle_case_pass_rate"), F.round(F.avg((F.col("classification") == "pass").cast("double")), 4).alias("grounded_case_pass_rate"),
    )
    caught = adversarial.agg(F.count("*").alias("adversarial_total"), F.count_if("detected").alias("adversarial_detected"), F.count_if("legacy_detected").alias("legacy_detected"))
    indexed = chunks.agg(F.count("*").alias("indexed_chunks"))
    one = summary.crossJoin(caught).crossJoin(indexed)  # each has one row
    gate_passed = (F.col("grounded_case_pass_rate") == 1) & (F.col("adversarial_detected") == F.col("adversarial_total"))
    return cases, adversarial, one.withColumn("gate_passed", gate_passed)
