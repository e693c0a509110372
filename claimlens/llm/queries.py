"""Registered queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlens.llm import (
    decontaminate, hard_negatives, html_text, language, license_scan, mixing, order_minhash, phrase_dedup, ranked_search, revisits, simhash, token_counts, token_files,
)
from claimlens.llm.common import read_table
from claimlens.llm.sql import ORACLE
from claimlens.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

__all__ = ["ORACLE", "REGISTRY"]


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer's file; the folder is installed beside Python, never copied here."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read_table(spark, sf_dir, "documents")).drop("weight")


@query
def op2_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve(revisits.captures_of(read_table(spark, sf_dir, "pages")))
    fields = F.array_join(F.transform("merged_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return found.select("record_id", "url_key", "captured_at", "outcome", "response_id", "response_sha256", fields.alias("headers"))


@query
def op3_phrase_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phrase_dedup.dedup_spans(read_table(spark, sf_dir, "documents"))
    removed = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.begin)")
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "start", "similarity")


@query
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@query
def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.col("lang").alias("declared"), F.col("source").alias("host"))
    found = language.identify(rows, language.fit(docs, "text", "lang"))
    return found.select("doc_id", "language", "posterior", "text_language", "accepted")


@query
def language_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: markup language, host and address suffix of each page are evidence."""
    markup = r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>"
    rows = read_table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("html", markup, " ").alias("text"),
        F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z-]+)", 1), F.lit("")).alias("declared"),
        F.expr("try_parse_url(url, 'HOST')").alias("host"),
    )
    model = language.fit(read_table(spark, sf_dir, "documents"), "text", "lang")
    return language.identify(rows, model).select("page_id", "language", "posterior", "text_language", "accepted")


@query
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    tokenizer = Path(tokenizer_file("word_bpe_49k.json")).read_text()
    token_files.write_token_files(read_table(spark, sf_dir, "documents"), path, tokenizer)
    return token_files.with_crc32(token_files.token_spans(spark, path).drop("part"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = Path(tokenizer_file("byte_bpe_50k.json")).read_text()
    return token_counts.token_counts(read_table(spark, sf_dir, "documents"), tokenizer)


@query
def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(read_table(spark, sf_dir, "documents"))


def _labels(column):
    return F.array_join(F.array_sort(F.array_distinct(column)), ",")


@query
def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read_table(spark, sf_dir, "documents"))
    best = F.coalesce(F.array_max(F.col("blocks.containment")), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(F.col("places.start")).cast("long").alias("first_word"),
        F.array_max(F.col("places.start")).cast("long").alias("last_word"), _labels(F.col("places.label")).alias("base_labels"),
        _labels(F.concat(F.col("places.label"), F.col("blocks.label"))).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table.select(F.col("vec_id").alias("id"), label.alias("label"), hard_negatives.integer_vectors(table).alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 50 == 0)


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
