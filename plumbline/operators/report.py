"""Reports from bounded results: a text table, Markdown, JSON, and the exit code of a gate."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from plumbline.functions.text import display_width, pad_display, truncate_display


def table(headers: list[str], rows: list[list[str]], aligns: list[str] | None = None) -> str:
    """A box of columns padded by display width, so that wide characters line up."""
    aligns = aligns or ["left"] * len(headers)
    widths = [max(display_width(str(r[i])) for r in [headers, *rows]) for i in range(len(headers))]
    rule = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda cells, how: "| " + " | ".join(pad_display(str(c), w, a) for c, w, a in zip(cells, widths, how, strict=True)) + " |"
    return "\n".join([rule, line(headers, ["center"] * len(headers)), rule, *[line(r, aligns) for r in rows], rule])


def text_report(summary: DataFrame, results: DataFrame, questions: dict[str, str] | None = None, recall_min: float = 0.80, width: int = 28) -> str:
    """Summary, a row for each result, reasons of failure, and a warning where recall is good but the answer is not."""
    s, rows, questions = summary.first(), results.orderBy("sample_id").collect(), questions or {}
    mark = lambda ok: "PASS" if ok else "FAIL"
    out = [f"total {s.total}  passed {s.passed}  failed {s.failed}  recall {s.avg_context_recall:.4f}  completeness {s.avg_completeness:.4f}  faithful {s.faithfulness_pass_rate:.4f}  cases {s.case_pass_rate:.4f}"]
    cells = [[r.sample_id, truncate_display(questions.get(r.sample_id, "-"), width), f"{r.context_recall_score:.4f}", f"{r.completeness_score:.4f}", mark(r.faithfulness_pass), mark(r.required_entities_pass), mark(r.case_passed)] for r in rows]
    out.append(table(["sample", "question", "recall", "complete", "faithful", "required", "case"], cells, ["left", "left", "right", "right", "center", "center", "center"]))
    out += [f"- {r.sample_id}: {'; '.join(r.error_details)}" for r in rows if not r.case_passed]
    cut = [r.sample_id for r in rows if not r.faithfulness_pass and r.context_recall_score >= recall_min]
    if cut:
        out.append(f"WARNING: unfaithful although the context was retrieved: {', '.join(cut)}")
    return "\n".join(out)


def markdown(title: str, df: DataFrame) -> str:
    """A bounded table as Markdown."""
    rows = [["" if v is None else str(v) for v in r] for r in df.collect()]
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns), *["| " + " | ".join(r) + " |" for r in rows], ""])


def as_json(summary: DataFrame) -> dict:
    """The one row of a summary as plain JSON values."""
    return json.loads(summary.toJSON().first())


def exit_code(gate_passed: bool | None) -> int:
    """0: passed, 1: failed, 2: no verdict."""
    return 2 if gate_passed is None else 0 if gate_passed else 1
