"""The training-data pipeline: documents in, packed sequences out.

Each stage calls one operator of ``newsdigest.llm`` on all that the stage before kept; its rows are written as
Parquet in the shared folder and read again as the next stage's documents.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsdigest.llm import jaccard_join, nbsvm, packing, secrets, spaced_seeds
from newsdigest.llm.storage import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.filter(nbsvm.scores(docs, model) >= 0.5)


def row_key() -> Column:
    """What names a row: its id and two digests of its text.  Equal rows share it; rows without an id don't."""
    return F.struct("doc_id", *jaccard_join.digests(F.col("text")))


def fresh(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the least id, or without an id if none has one.  Repeated
    rows are one; rows of one id with different texts are judged each."""
    row, chosen = fresh(docs, "_row"), fresh(docs, "_stay")
    stay = jaccard_join.representatives(docs).select(F.struct("doc_id", *jaccard_join.DIGEST).alias(chosen))
    kept = docs.withColumn(row, row_key()).join(stay, F.col(row).eqNullSafe(F.col(chosen)), "left_semi")
    return kept.dropDuplicates([row]).drop(row)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; rows of one id, or without an id, are judged each by its own text."""
    row, leaking = fresh(docs, "_row"), fresh(docs, "_gone")
    rows = docs.withColumn(row, row_key())
    found = spaced_seeds.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=row)
    gone = written(found.select(F.col("doc_id").alias(leaking)).distinct(), "leaking-rows")
    return rows.join(spaced_seeds.bounded(gone, 2 * spaced_seeds.ROW_BYTES), F.col(row).eqNullSafe(F.col(leaking)), "left_anti").drop(row)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    return secrets.redact_secrets(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies: bin and offset."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: A fitted model and MinHash candidates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
