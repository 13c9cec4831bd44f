"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

1. quality: documents that the quality classifier rejects go.
2. ngram_join: of documents that are linked by a Jaccard similarity of 0.8 or more of their 5-word shingles, the one with the
   smallest doc_id stays.
3. decontamination: documents that hold a window of a benchmark item go.
4. mixing: sources are brought to their target weights; a document that is taken k times is k rows from here on.
5. token_output: the ids of what is left are written in the binary format; one row a document, as read back from the files.

Rows are judged one by one, so rows with a null or a repeated doc_id go through all stages: they are documents of their own to
quality, decontamination, mixing and token output. The n-gram join goes by doc_id: a row with a null one links with nothing and
stays, and rows that repeat one are one document, of which all rows stay or go. Null and empty texts go in the first stage, as
they have no word. Empty tables of documents, benchmark items or labels give empty or unfiltered stages. Extra columns stay to the
last stage, which returns its own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from skylattice.llm import decontamination, mixing, ngram_join, quality, token_output
from skylattice.llm.common import shared_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.apply_quality(docs, table(spark, sf_dir, "labels"))


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(docs, size=5, least=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_output.encoded(docs, token_output.default_tokenizer(), literal=False)


STAGES = [("quality", quality_stage), ("ngram_join", ngram_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("token_output", token_stage)]

#: Expectation-maximisation, training and the tokenizer are not for SQL; tests/llm holds the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}-{name}")
        docs = spark.read.parquet(f"{at}/{k}-{name}")
    return docs
