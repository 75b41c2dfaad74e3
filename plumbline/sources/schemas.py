"""Declared schemas, and sources and sinks of samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = (
    "id string, question string, ground_truth_context string, ground_truth_answer string, expected_entities array<string>, source_id string, "
    "required_entities array<string>, category string, candidate_answer string, mutation_type string"
)
PRESET = "sample_id string, context string, answer string"
FACT = "subject string, predicate string, object_value string, fact_type string, is_negative boolean, source_text string"


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of samples; a row that does not fit the schema fails the read."""
    return spark.read.schema(SAMPLE).option("multiLine", True).option("mode", "FAILFAST").json(path)


def invalid_samples(samples: DataFrame) -> DataFrame:
    """(id, violation): rows that break the constraints (blank id or missing required text)."""
    checks = [(F.coalesce(F.length("id"), F.lit(0)) == 0, "blank_id"), *[(F.col(c).isNull(), f"missing_{c}") for c in ("question", "ground_truth_context", "ground_truth_answer")]]
    found = F.array_compact(F.array(*[F.when(bad, name) for bad, name in checks]))
    return samples.select("id", F.explode(found).alias("violation"))


def write_json_array(samples: DataFrame, path: str) -> None:
    """Samples (a bounded set) as one JSON array file on the driver."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(x) for x in samples.toJSON().collect()], f, ensure_ascii=False, indent=2)
