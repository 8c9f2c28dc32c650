"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on all its predecessor kept; all but the last
return the columns of documents. run() writes each stage's rows as Parquet into the shared folder and reads them again,
so that a stage that is lost with an executor is redone from files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import line_dedup, mixing, packing, quality_rules, simhash
from tidegrid.llm.common import drop_durable, durable, made, table

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the rules are learned from the labelled ones among docs."""
    return quality_rules.keep_good(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of 3 lines or more, or of 50 words or more, are cut out of the texts."""
    return line_dedup.drop_repeated_lines(docs, min_words=50)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: fingerprints at 2 bits or less, or 5-word Jaccard of 0.8 or more."""
    return simhash.keep_one(docs, similar=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order; texts stay whole."""
    return mixing.mix(docs, whole=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every copy with its place in a sequence. Workers hold less than op5's do (311 MB instead of 520 at most,
    for a quarter more time): here they stand beside what the stages before have grown an executor's heap to."""
    return packing.pack_documents(docs, TOKENIZER, slice_bytes=4_000_000, remembered=150_000)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus. A stage's own tables go as soon as its rows are written; those of other queries stay."""
    docs, others = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
        drop_durable(spark, keep=[*others, made()[-1]])
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned rules, XXH64 fingerprints and a tokenizer have no SQL form; tests/llm compares run() with a plain version.
ORACLE_SQL = None
