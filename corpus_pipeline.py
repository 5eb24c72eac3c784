"""From raw documents to token ids: quality rules, near duplicates, repeated passages,
benchmark leaks, encoding.

Each stage gets what its predecessor kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marram.llm import bpe, leaks, quality, repeats, similar
from marram.llm.common import discard, materialise

STAGES = [
    ("quality_rules", quality.filter_stage),
    ("ngram_jaccard", similar.distinct_stage),
    ("suffix_dedup", repeats.cut_stage),
    ("benchmark_decontamination", leaks.clean_stage),
    ("byte_bpe", bpe.encode_stage),
]

#: The stages learn thresholds, sort suffixes and merge bytes; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document that the stages keep.

    A stage's table is deleted once the next one is written; a document goes by doc_id and
    text, so ids may be null or repeated, and empty tables give no rows.
    """
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return docs
