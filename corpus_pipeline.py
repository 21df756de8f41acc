"""The corpus pipeline: quality rules, line dedup, near duplicates, secrets, packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame.  All but the last return the columns of ``documents``.
``run`` writes each stage's rows as Parquet in the shared folder and hands the
reread table to the next.

* quality_rules: documents that fail the base check or that a learned rule rejects go.
* line_dedup: lines that are boilerplate on their source are cut from the text.
* ngram_join: of each component of near duplicates the smallest doc_id stays;
  documents without words have no link and stay.
* secret_scan: secrets are masked in the text; every document stays.
* packing: the remaining texts become token sequences.

Rows with a null doc_id pass through every filter as documents of their own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slopebook.llm import curve_packing, line_dedup, ngram_join, quality_rules, secret_scan
from slopebook.llm.common import table
from slopebook.plans.session import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.drop_lines(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_representatives(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return curve_packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_stage), ("line_dedup", line_stage), ("ngram_join", near_stage),
          ("secret_scan", secret_stage), ("packing", packing_stage)]

#: The rules are learned and the tokens come from a library: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
