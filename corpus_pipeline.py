"""From raw documents to token shards: language, near-duplicates, benchmark leaks, source weights, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the columns of
documents. Stages meet in Parquet files in the shared folder, so a lost executor costs tasks, not stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cordage.llm.common import cleared, delete, staged, table
from cordage.llm.decontaminate import without_contaminated
from cordage.llm.language_id import in_known_language
from cordage.llm.mixing import mixed_documents
from cordage.llm.near_copies import without_near_copies
from cordage.llm.queries import tokenizer_path
from cordage.llm.token_output import token_output


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return in_known_language(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (5-word shingles, similarity 0.8; SimHash candidates and those beyond its radius) stays."""
    return without_near_copies(spark, docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_contaminated(spark, docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken in blocks, less than once to twice, so that sources reach their target weights."""
    return mixed_documents(spark, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards, reported by document as the files hold it."""
    return token_output(spark, docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
#: Trained models, graph components and file formats are beyond SQL: tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, start, n_tokens, ids_crc32. What a stage wrote on its way is deleted once its result is written."""
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with cleared(spark) as written:
            docs = staged(stage(spark, docs, sf_dir), name)
            result = written.pop()
        if path:
            delete(spark, path)
        path = result
    return STAGES[-1][1](spark, docs, sf_dir)
