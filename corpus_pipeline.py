"""Corpus pipeline: documents -> quality rules -> exact dedup -> near-dedup -> source mix ->
packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns of
``docs``: the quality rules drop rejected documents and take common lines out of the others'
texts, the dedup stages keep one document of each group, and the mix makes each text the
words it takes from it (up to twice).  The last one returns the pieces of the sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from homecast.llm import best_fit, chunk_dedup, line_quality, minhash_bayes, mixing
from homecast.llm.common import documents, materialize, tokenizer_path

#: Near-duplicates share 80 % or more of their shingles of five words.
NEAR_WIDTH, NEAR_PERCENT = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_quality.cleaned(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunk_dedup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash_bayes.representatives(docs, percent=NEAR_PERCENT, width=NEAR_WIDTH)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_dedup),
    ("near-dedup", near_dedup),
    ("source mix", source_mix),
    ("packing", packing),
]

#: Near-dedup, the mix's draws and the token ids are not SQL; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
