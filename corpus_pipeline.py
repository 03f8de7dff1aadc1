"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, PII, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sessionlake.llm.decontamination import decontamination_stage
from sessionlake.llm.near_dup import near_dup_stage
from sessionlake.llm.packing import packing_stage
from sessionlake.llm.pii import pii_stage
from sessionlake.llm.shared import materialise, shared_folder
from sessionlake.llm.toxicity import toxicity_stage

STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express hashing, training or packing; tests/llm holds the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage but the last is written to the shared folder and read back as the next one's documents."""
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"{folder}/{k}-{name}")
    return docs
