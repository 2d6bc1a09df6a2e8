"""The queries of this subpackage, and the SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import chat, decontaminate, html_text, jaccard, ngram_lm, packing, periodic, quality, secrets, shards, token_files, toxicity, whitening
from ledgerlark.llm.common import new_folder, table
from ledgerlark.llm.tokenise import tokenizer_path


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"), size=4, percent=85)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, folder)


def op6_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shards.shard(table(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2, most=1024)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotated(table(spark, sf_dir, "conversations"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.scored(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.find(periodic.looped(table(spark, sf_dir, "documents"))))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_secrets, op3_jaccard_join, op4_quality_rules, op5_token_files, op6_lpt_shards, op7_best_fit_packing, op8_toxicity, op9_perspectives, op10_main_text,
                                    op11_interpolated_lm, op12_whitening, op13_periodic_runs)}
SQL: dict[str, str] = {"op9_perspectives": chat.SQL}
