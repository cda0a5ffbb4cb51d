"""From raw documents to a mixed corpus in pieces: five stages, each written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from saldo.llm.chunk_dedup import chunk_dedup_stage
from saldo.llm.common import stored, table
from saldo.llm.pieces import pieces_stage
from saldo.llm.quality_rules import quality_stage
from saldo.llm.simhash import simhash_stage
from saldo.llm.source_mix import mix_stage

STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", chunk_dedup_stage),
    ("mixing sources", mix_stage),
    ("SentencePiece", pieces_stage),
]

#: Fingerprints, chunk digests and pieces are beyond SQL: tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
