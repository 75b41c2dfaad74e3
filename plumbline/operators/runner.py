"""Evaluate samples against responses, and sum results up."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import scorers

REFUSAL = "抱歉，未能检索到相关政策内容。"


def with_responses(samples: DataFrame, presets: DataFrame) -> DataFrame:
    """Each sample with its preset (sample_id, context, answer); without one, no context and a refusal."""
    got = presets.select(F.col("sample_id").alias("_sid"), "context", "answer")
    return samples.join(got, samples["id"] == F.col("_sid"), "left").drop("_sid").withColumns({"context": F.coalesce("context", F.lit("")), "answer": F.coalesce("answer", F.lit(REFUSAL))})


@dataclass(frozen=True)
class Scorer:
    """A metric of samples with ``context`` and ``answer``: a name and a function that gives (score, passed, details).

    Functions of expressions give a struct Column. Functions of Python, ``(row: dict) -> (score, passed, details)``, come
    by ``Scorer.of_rows`` and run in Arrow batches; what they raise counts against their own metric and row only.
    """

    name: str
    score: Callable[[], Column]

    @staticmethod
    def of_rows(name: str, function: Callable[[dict], tuple], columns: tuple[str, ...] = ("question", "context", "answer", "ground_truth_context", "ground_truth_answer")) -> Scorer:
        @F.pandas_udf("score double, passed boolean, details array<string>")
        def run(*cells: pd.Series) -> pd.DataFrame:
            out = []
            for row in zip(*cells, strict=True):
                try:
                    score, passed, details = function(dict(zip(columns, row, strict=True)))
                    out.append((None if score is None else float(score), bool(passed), list(details)))
                except Exception as e:  # noqa: BLE001  a metric's failure is a result of that metric
                    out.append((0.0, False, [f"[harness] {name}: {e!r}"]))
            return pd.DataFrame(out, columns=["score", "passed", "details"])

        return Scorer(name, lambda: run(*[F.col(c) for c in columns]))


def default_scorers(recall_min: float = 0.80, complete_min: float = 0.80) -> list[Scorer]:
    return [
        Scorer("context_recall", lambda: scorers.context_recall(F.col("ground_truth_context"), F.col("context"), recall_min)),
        Scorer("completeness", lambda: scorers.completeness(F.col("expected_entities"), F.col("answer"), complete_min)),
        Scorer("faithfulness", lambda: scorers.faithfulness(F.col("context"), F.col("answer"))),
    ]


#: Columns of samples and responses that are compared; they are composed (NFC) before anything else.
TEXTS = ("question", "ground_truth_context", "ground_truth_answer", "expected_entities", "required_entities", "context", "answer")


def evaluate(samples: DataFrame, recall_min: float = 0.80, complete_min: float = 0.80, metrics: list[Scorer] | None = None) -> DataFrame:
    """Results of samples that carry ``context`` and ``answer``.

    The gate of required entities holds whatever the metrics are. Metrics other than the three defaults add their details
    only; without context recall or completeness its score is 0, without faithfulness the answer counts as faithful. A
    metric whose expression cannot be built is a failure of that metric, said in the details.
    """
    metrics = default_scorers(recall_min, complete_min) if metrics is None else metrics
    none = F.array().cast("array<string>")
    outcomes: dict[str, Column] = {}
    for m in metrics:
        try:
            outcomes[m.name] = m.score()
        except Exception as e:  # noqa: BLE001  see above
            outcomes[m.name] = F.struct(F.lit(0.0).alias("score"), F.lit(False).alias("passed"), F.array(F.lit(f"[harness] {m.name}: {e!r}")).alias("details"))
    gate = scorers.required_entities(F.coalesce("required_entities", F.array().cast("array<string>")), F.col("answer"))
    whole = T.composed(samples, *[c for c in TEXTS if c in samples.columns])
    scored = whole.select("*", gate.alias("_gate"), *[c.alias(f"_m_{n}") for n, c in outcomes.items()])
    of = lambda n, field, default: F.coalesce(F.col(f"_m_{n}.{field}"), F.lit(default)) if n in outcomes else F.lit(default)
    recall, complete, faithful = of("context_recall", "score", 0.0), of("completeness", "score", 0.0), of("faithfulness", "passed", "faithfulness" not in outcomes)
    required = F.col("_gate.passed") & of("required_entities", "passed", True)
    told = [F.when(F.col(f"_m_{n}.passed"), none).otherwise(F.coalesce(F.col(f"_m_{n}.details"), none)) for n in outcomes if n != "required_entities"]
    return scored.select(
        F.col("id").alias("sample_id"),
        F.col("context").alias("actual_context"),
        F.col("answer").alias("actual_answer"),
        recall.alias("context_recall_score"),
        complete.alias("completeness_score"),
        faithful.alias("faithfulness_pass"),
        required.alias("required_entities_pass"),
        F.concat(*told, "_gate.details").alias("error_details"),
        scorers.case_passed(recall, complete, faithful, required, recall_min, complete_min).alias("case_passed"),
    )


def mean_of_scores(score) -> Column:
    """The mean of scores of four decimals, to four decimals (halves up), 0 of none.

    Scores are summed up as whole ten-thousandths, so the mean does not depend on the order of the rows.
    """
    units = F.round((F.col(score) if isinstance(score, str) else score) * 10000).cast("long")
    total, n = F.sum(units), F.count(units)
    return F.coalesce(F.floor(F.try_divide(total * 2 + n, n * 2)) / 10000.0, F.lit(0.0))


def summarize(results: DataFrame, *keys: str) -> DataFrame:
    """Counts and rates (four decimals) over all results, or by keys; no results make one row of zeros."""
    flag = lambda c: F.col(c).cast("int")
    return results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("case_passed").alias("passed"),
        F.count_if(~F.col("case_passed")).alias("failed"),
        mean_of_scores("context_recall_score").alias("avg_context_recall"),
        mean_of_scores("completeness_score").alias("avg_completeness"),
        mean_of_scores(flag("faithfulness_pass")).alias("faithfulness_pass_rate"),
        mean_of_scores(flag("case_passed")).alias("case_pass_rate"),
    )


def failed_results(results: DataFrame) -> DataFrame:
    return results.where(~F.col("case_passed"))


def scissors(results: DataFrame, recall_min: float = 0.80) -> DataFrame:
    """Unfaithful answers although the context was there."""
    return results.where(~F.col("faithfulness_pass") & (F.col("context_recall_score") >= recall_min))
