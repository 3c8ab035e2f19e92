"""A corpus pipeline of five of the training-data operators, each stage written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tracklight.llm.common import shared_folder, table
from tracklight.llm.stages import encode_pieces, language_id, mix_sources, near_dedup, quality_rules

STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("sentence_pieces", encode_pieces),
]

#: The fitted models and the fingerprints aren't SQL's to express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from `documents` on; each one's rows are written as Parquet in the shared folder and read again by the next."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
