"""A training corpus in five stages: known language, no near-duplicates, no benchmark items, mixed sources, token ids.

Each stage takes the documents that its predecessor kept, from Parquet, and returns a DataFrame. All but the last return
the columns of ``documents``; the last writes token files and returns doc_id, start, n_tokens and ids read from them.
Documents that the mixture takes in several epochs appear as often from there on.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import decontaminate, language, mixing, simhash, token_files
from claimlens.llm.common import read_table
from claimlens.llm.queries import tokenizer_file
from claimlens.session import scratch_path, stage

TOKENIZER = "word_bpe_49k.json"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents of a known language, by text, catalogue entry and source.

    A null or empty text, one without letters and one of an unknown language go; a null language or source is no evidence.
    Repeated rows stay or go together. An empty table stays empty; without any labelled row every text with a letter stays.
    """
    # the same text, entry and source get the same decision, so their hashes name what goes; that is little. A hash starts
    # from those of the columns before, so the number that tells the two apart comes first
    key = [F.xxhash64(F.lit(k), "text", F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))) for k in (1, 2)]
    evidence = docs.select(key[0].alias("key_1"), key[1].alias("key_2"), "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    unknown = language.identify(evidence, language.fit(docs, "text", "lang")).where("not accepted").select("key_1", "key_2").distinct()
    unknown = stage(unknown, "pipeline-unknown")
    return docs.join(unknown, (key[0] == unknown["key_1"]) & (key[1] == unknown["key_2"]), "left_anti")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of every group of near-duplicates: the one of smallest doc_id, of equal ones any.

    Texts without words, null ones among them, form one group. Other columns may have any name; an empty table stays empty.
    """
    return simhash.keep_one(docs, words=3, most_bits=3)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without an item of the benchmark; those with a null or empty text have none. Repeated rows stay or go together."""
    return decontaminate.without_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes the words of each source up to its target; a null source is a source like others, a text without words adds nothing."""
    return mixing.mixture(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token files and reads them back; a null or empty text is the end id alone, repeated rows follow each other."""
    path = scratch_path(spark, "pipeline-tokens")
    token_files.write_token_files(docs, path, Path(tokenizer_file(TOKENIZER)).read_text())
    return token_files.token_spans(spark, path).drop("part")


STAGES = [
    ("language_id", language_id), ("near_dedup", near_dedup), ("without_benchmark", without_benchmark), ("mix", mix),
    ("tokens", tokens),
]

# Language models and XXH64 fingerprints are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
