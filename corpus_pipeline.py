"""The corpus pipeline: five stages over ``documents``, each one operator of :mod:`inkwell.llm`.

Every stage reads what the previous one wrote. Filters take effect on the rows, secrets are masked in the texts, and
the last stage packs what is left.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkwell.llm import decontaminate, ngram_join, packing, quality_model, queries, secrets
from inkwell.llm.common import shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit the classifier on the labelled documents that are not held out; documents scored under one half go."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality_model.score(docs.select(*COLUMNS), model, carry=COLUMNS)
    return scored.where(F.col("score") >= 0.5).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id, once. Rows are judged each by its text: of rows with
    the same id and different texts, one may go and another stay. Documents without an id or without words stay."""
    found = ngram_join.link_documents(docs)
    gone = found.where(~F.col("first")).select("doc_id")
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    kept = docs.join(again, "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*COLUMNS)
    several = ngram_join.with_signature(docs.join(again, "doc_id", "left_semi").select(*COLUMNS))
    stays = found.where("first and n_shingles > 0").select("doc_id", "sig").distinct()
    once = several.where("n_shingles > 0").join(stays, ["doc_id", "sig"], "left_semi").groupBy("doc_id", "sig").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return kept.unionByName(several.where("n_shingles = 0").select(*COLUMNS)).unionByName(once.select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; spans of benchmark windows below the coverage limit are cut out of the others."""
    found = decontaminate.decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), carry=COLUMNS, with_text=True)
    cut = F.col("n_hit") > 0
    return found.where(~F.col("contaminated")).select(
        "doc_id", F.when(cut, F.col("clean_text")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(cut, F.length("clean_text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    )


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    found = secrets.scan_secrets(docs.select(*COLUMNS), carry=COLUMNS)
    hit = F.size("spans") > 0
    masked = found.withColumn("__masked", secrets.mask_secrets("text"))
    return masked.select("doc_id", F.when(hit, F.col("__masked")).otherwise(F.col("text")).alias("text"), "lang", "source", F.when(hit, F.length("__masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, str(queries.tokenizer_path()))


STAGES = [("quality classifier", quality), ("n-gram jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secret_scan), ("packing", pack)]

#: The classifier, the random field and the tokenizer have no SQL; tests hold the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
