"""The corpus pipeline: language ID, SimHash near-dedup, benchmark decontamination, secret
redaction and mixing, each over everything the stage before it kept.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its result is written
as Parquet to the shared folder and read back as the next stage's input, so a lost
executor costs at most the running stage. All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskengine.llm import decontaminate, langid, mixing, secrets, simhash
from riskengine.llm.common import read, staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is rejected (no letters, or a narrow margin)."""
    out = langid.identify(docs, docs.where(~langid.held_out()))
    return out.where("accepted").select(*docs.columns)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of every near-duplicate group."""
    return simhash.one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark window."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks every secret found; no document is dropped."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy in the mix: the documents' columns with shard, copy and position
    (which replace columns of those names)."""
    added = ["shard", "copy", "position"]
    return mixing.shuffled(mixing.mix(docs)).select(*[c for c in docs.columns if c.lower() not in added], *added)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("mixing", mixing_stage),
]

# Language ID, fingerprints and the secret battery are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
