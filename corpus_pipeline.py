"""The corpus pipeline: documents in, clean and encoded documents out.

Five stages, each on all that its predecessor kept; a stage's result is
written as Parquet and read again as the next one's input.  The first four
return the columns of ``documents``; the last adds the piece ids.

1. quality classifier: documents that score below quality.REJECT go.
2. line dedup: lines that at least three documents hold go, but for the last
   holder; text and n_chars change.
3. n-gram Jaccard join: of each group of linked documents the one with the
   smallest doc_id stays.
4. benchmark decontamination: documents that hold a test item go.
5. SentencePiece encoding: n_pieces and piece_ids.

Nulls, empty texts, repeated rows, empty tables and further columns follow
the operators' own docstrings: null and empty texts pass stages 2 to 5
unchanged, rows that repeat a doc_id stay or go together, further columns are
carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskmart.llm import decontaminate, lines, near, pieces, quality
from riskmart.llm.spark import public_tokenizer, table, written

PIECE_MODEL = "piece_bpe_32k.model"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_ids(docs, public_tokenizer(PIECE_MODEL))


STAGES = [
    ("quality_classifier", quality_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece", piece_stage),
]

#: SQL cannot express the trained classifier; tests/llm holds the pipeline
#: against its stages done by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = written(docs, name) if k < len(STAGES) - 1 else docs
    return docs
