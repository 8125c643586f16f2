"""A corpus made ready for training: five stages, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import decontaminate, packing, secret_scan, simhash, toxicity
from tessella.llm.common import crc32_text, stage, table, unstage

#: Documents with a toxicity score of this much or more are rejected, as operator 9 decides.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC by a model of the labelled documents that the held-out rule leaves.

    A null text is scored as the empty one; repeated rows and null ids are scored like any other and stay or go alike.
    """
    source = table(spark, sf_dir, "documents")
    model = toxicity.train(source, table(spark, sf_dir, "labels"), "toxic", F.pmod(crc32_text(F.col("doc_id")), F.lit(4)) != 2)
    name = "score"
    while name in docs.columns:
        name += "_"
    return toxicity.score(docs, model, *docs.columns, name=name).filter(F.col(name) < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id.

    Rows with a null doc_id stay; repeated rows stay or go together; blank and null texts are copies of each other.
    """
    groups = simhash.similar_documents(docs)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tiles cover no benchmark item; null texts, null ids and repeated rows are treated like any other row."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mask; n_chars follows. Null texts stay null."""
    out = secret_scan.redact(docs, secret_scan.train(docs.select("doc_id", "text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows; a null text has the end id alone, repeated rows and null ids are packed each."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", mask_secrets),
    ("packing", pack),
]
#: Models, tilings and tokens are beyond SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage wrote is deleted once the next one has written."""
    docs, written = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
        if written is not None:
            unstage(written)
        written = docs
    return docs
