"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontamination, packing, simhash_dedup, substring_dedup, toxicity
from pulsegrid.llm.common import neutral
from pulsegrid.sources.stage import materialise

TOKENIZER = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash_dedup.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside repeated windows go; a document without any keeps its text as it is."""
    names, plain = docs.columns, neutral(docs)
    own = dict(zip(names, plain.columns, strict=True))
    out = substring_dedup.drop_repeats(plain, own["doc_id"], own["text"])
    cut = F.col("_n_removed") > 0
    new = {own["text"]: F.when(cut, F.col("_kept_text")).otherwise(F.col(own["text"]))}
    if "n_chars" in names:
        new[own["n_chars"]] = F.when(cut, F.length("_kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(own["n_chars"]))
    return out.withColumns(new).select(*plain.columns).toDF(*names)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    return decontamination.drop_leaks(docs, _table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 4096 tokens, one row per piece, with its ids as little-endian unsigned 32-bit numbers."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None
"""SQL expresses neither the learned grammar nor the tokenizer: the tests compare with a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
