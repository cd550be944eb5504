"""The corpus pipeline: stages over documents, each written as Parquet and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spliceflow.llm import stages
from spliceflow.llm.common import shared_folder

#: (name, function): function(spark, docs, sf_dir) -> DataFrame; all but the last return the columns of documents.
STAGES = [
    ("toxicity", stages.toxicity),
    ("near_dedup", stages.near_duplicates),
    ("decontamination", stages.decontaminate),
    ("pii", stages.redact_pii),
    ("packing", stages.pack),
]

#: The stages learn, hash and tokenise, which SQL can't express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on documents; each result is a table in the folder that driver and executors share."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}-{name}-{uuid.uuid4().hex[:8]}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
