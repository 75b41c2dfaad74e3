"""Command line: ``python -m plumbline.cli demo`` or ``baseline [--n N] [--top-k K] [--dataset FILE] [--output FILE]``.

The exit code is the gate: 0 passed, 1 failed, 2 wrong arguments.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from plumbline.operators import audit, report, runner
from plumbline.sources import samples, schemas


def demo(spark: SparkSession) -> int:
    rows = samples.builtin_samples(spark)
    results = runner.evaluate(runner.with_responses(rows, samples.preset_responses(spark))).cache()
    summary = runner.summarize(results)
    print(report.text_report(summary, results, {r.id: r.question for r in rows.collect()}))
    return report.exit_code(summary.first().failed == 0)


def baseline(spark: SparkSession, n: int | None, top_k: int, dataset: str | None, output: str | None) -> int:
    rows = schemas.read_samples(spark, dataset) if dataset else samples.generated_samples(spark)
    rows = rows.withColumn("ordinal", F.monotonically_increasing_id())
    total = rows.count()
    if top_k < 1 or (n is not None and not 1 <= n <= total):
        print(f"n must be between 1 and {total}, top-k at least 1", file=sys.stderr)
        return 2
    rows = rows.orderBy("ordinal").limit(n or total).cache()
    found = [r.asDict() for r in audit.issues(rows).collect()]
    if found:  # no verdict on quality from a broken dataset
        out = {"schema_version": 2, "total": rows.count(), "data_issues": found, "gate_passed": False}
    else:
        cases, adversarial, summary = audit.baseline(rows, top_k)
        full = {"cases": [json.loads(x) for x in cases.orderBy("ordinal").toJSON().collect()], "adversarial": [json.loads(x) for x in adversarial.toJSON().collect()]}
        out = {"schema_version": 3, "top_k": top_k, "data_issues": []} | report.as_json(summary) | full
    if output:
        os.makedirs(os.path.dirname(os.path.abspath(output)), exist_ok=True)
        with open(output, "w", encoding="utf-8") as f:
            json.dump(out, f, ensure_ascii=False, indent=2)
    print(json.dumps({k: v for k, v in out.items() if k not in ("cases", "adversarial")}, ensure_ascii=False, indent=2))
    return report.exit_code(out["gate_passed"])


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="plumbline")
    parser.add_argument("mode", choices=("demo", "baseline"))
    parser.add_argument("--n", type=int)
    parser.add_argument("--top-k", type=int, default=3)
    parser.add_argument("--dataset")
    parser.add_argument("--output")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("plumbline").getOrCreate()
    return demo(spark) if args.mode == "demo" else baseline(spark, args.n, args.top_k, args.dataset, args.output)


if __name__ == "__main__":
    raise SystemExit(main())
