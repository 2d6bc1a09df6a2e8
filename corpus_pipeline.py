"""A document pipeline of five stages, each written as Parquet and read again before the next.

Toxicity rejects documents; the Jaccard join keeps the document with the smallest doc_id of each component; decontamination
rejects documents with a passage of the benchmark; secret scans replace secrets in the texts; best-fit packing returns the
pieces of all that is left with their places in sequences of 1024 tokens.

Edge cases: rows with a null or empty text pass the first four stages and are packed as their end id; rows with equal doc_id
pass or go together (the join keeps each row that bears the smallest doc_id of its component); a null doc_id is its own key;
an empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlark.llm import decontaminate, jaccard, packing, secrets, toxicity
from ledgerlark.llm.common import new_folder, table
from ledgerlark.llm.tokenise import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    parts = jaccard.components(docs, size=5, percent=80)
    keep = parts.where("doc_id <=> component_id").select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(keep, docs["doc_id"].eqNullSafe(keep["_d"]), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))
    hit = found.where("contaminated").select(F.col("doc_id").alias("_d")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["_d"]), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2, most=1024)


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("best_fit_packing", packed),
]

#: A trained classifier, token ids and packing are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
