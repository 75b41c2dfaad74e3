"""What can be plugged in. Everything takes and gives tables or Columns, so a plug-in works on any number of rows."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame


class Backend(Protocol):
    """The system under test: samples in, samples with ``context`` and ``answer`` out (see ``runner.evaluate``)."""

    def __call__(self, samples: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Documents (doc_id, text) to chunks (chunk_id, doc_id, idx, content)."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class VectorEngine(Protocol):
    """The n best (query_id, rank, doc) of each query."""

    def __call__(self, queries: DataFrame, n: int) -> DataFrame: ...


class Retriever(Protocol):
    """The k best (query_id, rank, doc, score) of each query."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


class BlockProvider(Protocol):
    """(query_id, blocks): the contents of the k best hits in order, for ``scorers.hit_at_k``."""

    def __call__(self, queries: DataFrame, k: int) -> DataFrame: ...


class Extractor(Protocol):
    """Adds atomic_facts, facts and extraction_mode to rows with a question and a context."""

    def __call__(self, rows: DataFrame) -> DataFrame: ...


class Synthesizer(Protocol):
    """The answer from (atomic_facts, facts, extraction_mode)."""

    def __call__(self, atomic: Column, facts: Column, mode: Column) -> Column: ...


class Corrector(Protocol):
    """Adds a repaired payload to rows that failed (see ``generation.decode``)."""

    def __call__(self, failed: DataFrame) -> DataFrame: ...


class Judge(Protocol):
    """Whether the context supports the claim; null is no."""

    def __call__(self, context: Column, claim: Column) -> Column: ...


class Protect(Protocol):
    """What happens to a text before it is cut into tokens."""

    def __call__(self, text: Column) -> Column: ...


class Rule(Protocol):
    """Findings of a fact against a context (see ``rules.RuleMatrix.register``)."""

    def __call__(self, fact: Column, context: Column) -> Column: ...
