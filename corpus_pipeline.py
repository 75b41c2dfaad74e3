"""Corpus preparation: language ID, line dedup, near-dedup, benchmark decontamination, BPE encoding.

Every stage takes all rows that the stage before it kept, as Parquet; all but the last return the columns of documents.

Null and empty texts, and texts without letters, are in no known language and go first. Rows without an id stay through line
dedup, near-dedup and decontamination as they are. Rows that repeat id and text leave one row behind after line dedup; rows
that share an id only are told apart by their texts there, and stay or go together afterwards. Of lines and documents that
are copies the one of the smallest id stays, so ties are settled. An empty table gives no rows. Extra columns, whatever
their names, are kept up to the last stage, which returns the encoding's columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import language_id
from plumbline.llm.bpe_transducer import compile_lexicon, round_trip
from plumbline.llm.decontaminate import without_leaks
from plumbline.llm.line_dedup import without_duplicate_lines
from plumbline.llm.minhash_join import near_duplicates
from plumbline.llm.scratch import Scratch


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; their source is the host. Models are fitted on labelled documents of the table."""
    model = language_id.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return language_id.identify(docs, model, host="source").where("lang_accepted").select(docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each group of fuzzy copies stays; documents without a line left go."""
    return without_duplicate_lines(docs).withColumn("n_chars", F.length("text").cast("long"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, and so does every row without an id."""
    gone = near_duplicates(docs, size=5, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item stay."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(docs, tokenizer, compile_lexicon(spark, docs, tokenizer))


STAGES = [
    ("language ID", language_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("BPE encoding", encoding_stage),
]

#: SQL can express neither the language models nor the encoding; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
