"""A corpus pipeline: quality, near copies, benchmark leaks, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's docs. All but the last return the
columns of documents.

Defined results: null and empty texts are scored like all (they have no
evidence), have no words, no secrets, and are packed as a single end id; texts of
any length are worked on whole; of equal texts and of repeated rows with words one
row stays; rows with a null id go through all stages; extra columns are kept up
to the packing, whatever their names; empty documents give no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import contracts, decontaminate, jaccard, packing, quality, secrets
from tidemark.llm.common import cut, drop, drop_since, table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects (score under 0.5) go."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, column="_score").where(F.col("_score") >= 0.5).drop("_score").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the Jaccard join one row stays: that of the smallest id. Rows without words, linked with nothing, all stay."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; n_chars follows where a text has changed."""
    found = secrets.scan(docs, secrets.train(secrets.samples(docs)))
    changed = F.size("spans") > 0
    out = found.withColumn("text", secrets.redact("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids and places in sequences."""
    return packing.pack(docs, contracts.tokenizer())


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("packing", pack),
]

#: The classifier and the packing are learnt and solved, not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        mark = written()
        made = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_since(mark, made)
        drop(docs)
        docs = made
    return STAGES[-1][1](spark, docs, sf_dir)
