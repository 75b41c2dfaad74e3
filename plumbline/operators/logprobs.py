"""Token log-probabilities: perplexity, confidence, and doubtful entities of each response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T


def offsets(tokens: DataFrame) -> DataFrame:
    """Tokens (response_id, pos, token, logprob) with the characters they cover: start (from 0) and end."""
    before = Window.partitionBy("response_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.char_length("token")).over(before), F.lit(0))
    return tokens.withColumn("start", start).withColumn("end", F.col("start") + F.char_length("token"))


def confidence(tokens: DataFrame) -> DataFrame:
    """(response_id, n, ppl, avg_confidence): perplexity and mean probability."""
    return tokens.groupBy("response_id").agg(F.count("*").alias("n"), F.exp(-F.avg("logprob")).alias("ppl"), F.avg(F.exp("logprob")).alias("avg_confidence"))


def _escaped(words: Column) -> Column:
    return F.transform(F.filter(words, lambda w: F.length(w) > 0), lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))


def entity_spans(tokens: DataFrame, responses: DataFrame) -> DataFrame:
    """(response_id, ordinal, entity, start, end): numbers and critical entities in each response's text.

    Found texts and the text between them come from one pattern each, so a span starts where what stands before it ends.
    """
    whole = tokens.groupBy("response_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("text"))
    pattern = F.concat(F.lit(r"\d+(?:\.\d+)?%?"), F.array_join(F.transform(_escaped(F.coalesce("critical_entities", F.array().cast("array<string>"))), lambda w: F.concat(F.lit("|"), w)), ""))
    both = whole.join(responses.select("response_id", pattern.alias("pattern")), "response_id")
    both = both.withColumn("found", F.regexp_extract_all("text", "pattern", F.lit(0))).withColumn("gaps", F.split("text", F.col("pattern"), -1))
    # Java's split drops an empty head only for a zero-width match, which the pattern cannot have
    before = F.transform("found", lambda e, i: F.aggregate(F.slice("gaps", 1, i + 1), F.lit(0), lambda a, g: a + F.char_length(g)) + F.aggregate(F.slice("found", 1, i), F.lit(0), lambda a, g: a + F.char_length(g)))
    at = both.select("response_id", F.posexplode(F.arrays_zip(F.col("found").alias("entity"), before.alias("start"))).alias("ordinal", "s"))
    return at.select("response_id", "ordinal", F.col("s.entity").alias("entity"), F.col("s.start").alias("start"), (F.col("s.start") + F.char_length("s.entity")).alias("end"))


def analyze(tokens: DataFrame, responses: DataFrame, min_confidence: float = 0.50, max_ppl: float = 8.0, sole_veto: bool = False) -> DataFrame:
    """A report for each of ``responses`` (response_id, critical_entities, context).

    An entity whose least probable token is under ``min_confidence`` is flagged. Alone, flags and perplexity only veto
    with ``sole_veto``; else a response fails if a flagged entity is not in its context either. No tokens: it fails.
    """
    spans, placed = entity_spans(tokens, responses), offsets(tokens)
    s, t = spans.alias("s"), placed.alias("t")
    met = s.join(t, (F.col("s.response_id") == F.col("t.response_id")) & (F.col("s.start") < F.col("t.end")) & (F.col("t.start") < F.col("s.end")))
    least = met.groupBy(F.col("s.response_id").alias("response_id"), F.col("s.ordinal").alias("ordinal"), F.col("s.entity").alias("entity")).agg(F.min(F.struct(F.exp("t.logprob").alias("prob"), F.col("t.pos").alias("pos"), F.col("t.token").alias("token"), F.col("t.logprob").alias("logprob"))).alias("m"))
    flags = least.where(F.col("m.prob") < min_confidence).groupBy("response_id").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "entity", F.col("m.token").alias("suspect_token"), F.round("m.prob", 4).alias("confidence"), F.round("m.logprob", 4).alias("logprob")))).alias("flagged")
    )
    out = responses.join(confidence(tokens), "response_id", "left").join(flags, "response_id", "left")
    context = F.col("context")

    def lost(f: Column) -> Column:
        numbers = T.extract_numbers(f["entity"])
        missing = F.size(T.unsupported_numbers(numbers, T.bounded_numbers(T.normalize_faithfulness(context)))) > 0
        return F.when(F.size(numbers) > 0, missing).otherwise(~F.contains(T.normalize_for_match(context), T.normalize_for_match(f["entity"])))

    n_flags = F.coalesce(F.size("flagged"), F.lit(0))
    flagged = F.when(n_flags > 0, n_flags).otherwise(0)
    unsupported = F.when(context.isNull() | (flagged == 0), 0).otherwise(F.size(F.filter("flagged", lost)))
    high = F.coalesce(F.col("ppl") > max_ppl, F.lit(False))
    veto = high | (flagged > 0) if sole_veto else unsupported > 0
    return out.select(
        "response_id",
        (F.col("n").isNotNull() & ~veto).alias("passed"),
        F.coalesce(F.round("ppl", 2), F.lit(float("inf"))).alias("overall_ppl"),
        F.coalesce(F.round("avg_confidence", 4), F.lit(0.0)).alias("avg_confidence"),
        flagged.alias("n_flagged"),
        unsupported.alias("n_unsupported"),
        (F.col("n").isNotNull() & ((flagged > 0) | high)).alias("has_risk"),
    )
