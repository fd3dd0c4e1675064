"""A training corpus from raw documents: classify, deduplicate lines and documents, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as
the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from prismgraph.llm.common import Scratch, bound_batches, free_name
from prismgraph.llm.line_dedup import dedup_lines
from prismgraph.llm.mixing import apply_mix, mix_sources
from prismgraph.llm.near_dup import keep_one_each
from prismgraph.llm.packing import pack_documents
from prismgraph.llm.quality import held_out, score_column, train

THRESHOLD = 0.7


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a quality score of at least 0.7; the others go."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", learn=~held_out(), sample=4096)
    bound_batches(spark)
    return docs.filter(score_column(spark, model, F.col("text")) >= THRESHOLD)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of repeated runs of lines of five words or more; those that lose every line go."""
    lines, removed = free_name(docs.columns, "n_lines"), free_name(docs.columns, "n_removed")
    out = dedup_lines(spark, docs, min_words=5, added=(lines, removed)).filter((F.col(removed) == 0) | (F.col(removed) < F.col(lines)))
    changed = {"n_chars": F.when(F.col(removed) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that 5-gram similarities of 0.8 or more connect."""
    return keep_one_each(spark, docs, threshold=0.8)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return apply_mix(docs, mix_sources(spark, docs, weights=(3, 1, 2), share=1.5, cap=2.0)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens, with their ids."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, size=2048, with_ids=True)


STAGES = [("quality", classify), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: No stage but the exact grouping of lines can be written as SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
