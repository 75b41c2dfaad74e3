"""Evaluation of retrieval-augmented answers, and preparation of training data, on Spark."""

from plumbline.interfaces import Backend, BlockProvider, Chunker, Corrector, Extractor, Judge, Protect, Retriever, Rule, Synthesizer, VectorEngine
from plumbline.operators.facts import extract, realize, run_pipeline, synthesize, verify
from plumbline.operators.generation import decode, judge_accepts
from plumbline.operators.report import text_report
from plumbline.operators.retrieval import hybrid, select_context
from plumbline.operators.rules import RuleMatrix
from plumbline.operators.runner import Scorer, default_scorers, evaluate, failed_results, scissors, summarize, with_responses
from plumbline.operators.scorers import completeness, context_recall, faithfulness, hit_at_k, required_entities
from plumbline.sources.samples import builtin_samples, generated_samples, preset_responses

__version__ = "0.2.0"

__all__ = [
    "Backend", "BlockProvider", "Chunker", "Corrector", "Extractor", "Judge", "Protect", "Retriever", "Rule", "RuleMatrix", "Scorer", "Synthesizer", "VectorEngine",
    "builtin_samples", "completeness", "context_recall", "decode", "default_scorers", "evaluate", "extract", "failed_results", "faithfulness", "generated_samples", "hit_at_k", "hybrid", "judge_accepts",
    "preset_responses", "realize", "required_entities", "run_pipeline", "scissors", "select_context", "summarize", "synthesize", "text_report", "verify", "with_responses",
]
