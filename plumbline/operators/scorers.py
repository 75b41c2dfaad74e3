"""Scorers of one answer against gold text and entities; each gives a struct Column (score, passed, details)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions import text as T

RECALL_THRESHOLD = COMPLETENESS_THRESHOLD = 0.80


def _outcome(score: Column, passed: Column, details: Column) -> Column:
    return F.struct(score.cast("double").alias("score"), passed.alias("passed"), details.alias("details"))


def _share_of_terms(wanted: Column, have: Column) -> Column:
    """1 less the share of wanted terms that are not there; 1 if none is wanted."""
    return F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(T.rounded(1 - F.size(F.array_except(wanted, have)) / F.size(wanted)))


def context_recall(gold: Column, context: Column, threshold: float = RECALL_THRESHOLD, segments: int = 8) -> Column:
    """Share of the gold text's terms that the context has; the rounded share is compared with the threshold."""

    def told(have: Column) -> Column:
        return T.let(lambda found: F.concat(found["segments"], found["tokens"]), T.missing_segments(gold, have, segments))

    def outcome(have: Column, score: Column) -> Column:
        return _outcome(score, score >= threshold, F.when(score >= threshold, F.array().cast("array<string>")).otherwise(told(have)))

    scored = lambda wanted, have: T.let(outcome, have, _share_of_terms(wanted, have))
    return T.let(scored, T.extract_terms(gold), T.extract_terms(context))


def recall_score(gold: Column, context: Column) -> Column:
    """The share alone."""
    return T.let(_share_of_terms, T.extract_terms(gold), T.extract_terms(context))


def hit_at_k(gold: Column, blocks: Column, threshold: float = RECALL_THRESHOLD, context: Column | None = None) -> Column:
    """Share of the gold text's terms that the top blocks (array) have together; of no blocks (null), the context's."""
    joined = F.coalesce(F.array_join(blocks, "\n"), context if context is not None else F.lit(""))
    share = lambda wanted, have: F.when(F.size(wanted) == 0, F.lit(1.0)).otherwise(T.rounded(F.size(F.array_intersect(wanted, have)) / F.size(wanted)))
    return T.let(lambda score: _outcome(score, score >= threshold, F.array().cast("array<string>")), T.let(share, T.extract_terms(gold), T.extract_terms(joined)))


def completeness(entities: Column, answer: Column, threshold: float = COMPLETENESS_THRESHOLD) -> Column:
    """Share of the expected entities that the answer holds as substrings; repeated entities count each time."""
    lost = lambda whole: F.filter(entities, lambda e: ~F.contains(whole, T.normalize_for_match(e)))
    share = lambda missing: F.when(F.size(entities) == 0, F.lit(1.0)).otherwise(T.rounded((F.size(entities) - F.size(missing)) / F.size(entities)))
    outcome = lambda missing, score: _outcome(score, score >= threshold, missing)
    return T.let(lambda missing: T.let(outcome, missing, share(missing)), T.let(lost, T.normalize_for_match(answer)))


def required_entities(entities: Column, answer: Column) -> Column:
    """All required entities must be there; one that is empty once normalised never is."""
    absent = lambda whole, e: (e == "") | ~F.contains(whole, e)
    lost = lambda whole: F.filter(entities, lambda e: absent(whole, T.normalize_for_match(e)))
    return T.let(lambda missing: _outcome(F.lit(None), F.size(missing) == 0, missing), T.let(lost, T.normalize_for_match(answer)))


def faithfulness(context: Column, answer: Column, judged: Column | None = None) -> Column:
    """Every number of the answer must stand in the context. ``judged`` true accepts an answer that fails."""

    def outcome(unsupported: Column) -> Column:
        passed = F.size(unsupported) == 0
        passed = passed | F.coalesce(judged, F.lit(False)) if judged is not None else passed
        details = F.transform(unsupported, lambda n: F.concat(n["value"], F.when(n["pct"], "%").otherwise("")))
        return _outcome(F.lit(None), passed, F.when(passed, F.array().cast("array<string>")).otherwise(details))

    return T.let(outcome, T.unsupported_numbers(T.extract_faithfulness_numbers(answer), T.bounded_numbers(T.normalize_faithfulness(context))))


def case_passed(recall: Column, complete: Column, faithful: Column, required: Column | None = None, recall_min: float = RECALL_THRESHOLD, complete_min: float = COMPLETENESS_THRESHOLD) -> Column:
    """Without ``required`` the older rule holds, which has no required gate."""
    ok = (recall >= recall_min) & (complete >= complete_min) & faithful
    return ok & required if required is not None else ok
