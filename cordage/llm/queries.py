"""The queries of the training-data operators, each over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cordage.llm import bit_sliced, line_dedup, odd_sketch
from cordage.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.suffix_dedup import repeated_passages

    return repeated_passages(spark, table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.secrets import find_secrets

    return find_secrets(spark, table(spark, sf_dir, "documents"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.decontaminate import contaminated

    return contaminated(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.language_id import identify

    return identify(spark, table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.line_dedup import dedup_lines

    left = dedup_lines(spark, table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.quality import score

    return score(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.order_minhash import fingerprint_documents, written

    found = fingerprint_documents(spark, table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", written(F.col("fp")).alias("fingerprint"), written(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.token_output import token_output

    return token_output(spark, table(spark, sf_dir, "documents"), tokenizer_path())


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.mixing import taken_words

    mixed = taken_words(spark, table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_sliced.rank(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cordage.llm.importance import resample

    return resample(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.near_duplicates(spark, table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_secret_scan, op3_simhash_near_dedup, op4_decontamination, op5_language_id, op6_line_dedup, op7_quality_crf, op8_order_minhash, op9_token_output, op10_mix_sources, op11_lexical_search, op12_importance_resampling, op13_odd_sketch_near_dedup)}
ORACLE_SQL: dict[str, str] = {"op6_line_dedup": line_dedup.ORACLE_SQL, "op11_lexical_search": bit_sliced.ORACLE_SQL, "op13_odd_sketch_near_dedup": odd_sketch.ORACLE_SQL}
