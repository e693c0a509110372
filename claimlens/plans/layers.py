"""Raw to Bronze, Silver and Gold. Every layer is a written table that the next one reads."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import errors
from ..operators import clean, enrich, features, quality, rules
from ..schemas import RAW_SCHEMAS
from ..session import stage
from ..sources import tables

# Joined columns by the key that should have found them.
LOOKUPS = {"doctor_name": "provider_id", "category": "diagnosis_code", "expected_cost": "procedure_code"}
# Problems that end a strict run; the others are warnings.
FATAL = (errors.SCHEMA_MISMATCH, errors.FEATURE_ALL_NULL, errors.LABEL_IMBALANCE)


def build_silver(bronze: Mapping[str, DataFrame], date_format: str = "yyyy-MM-dd", **options) -> DataFrame:
    """Clean the four Bronze tables and join them: one shuffle (claim ids), three lookups."""
    return enrich.enrich_claims(
        clean.clean_claims(bronze["bronze_claims"], date_format),
        clean.clean_providers(bronze["bronze_providers"]),
        clean.clean_diagnosis(bronze["bronze_diagnosis"]),
        clean.clean_cost(bronze["bronze_cost"]),
        **options,
    )


def build_validated(bronze: Mapping[str, DataFrame], **options) -> DataFrame:
    return rules.apply_validation_rules(build_silver(bronze, **options))


def _problem(code: str, df: DataFrame, subject: Column | str, detail: Column) -> DataFrame:
    return df.select(F.lit(code).alias("code"), (F.col(subject) if isinstance(subject, str) else subject).alias("subject"), detail.alias("detail"))


def bronze_problems(bronze: Mapping[str, DataFrame]) -> DataFrame:
    """Columns that a Bronze table lacks, and expected columns with too many nulls."""
    name = F.concat_ws(".", "table_name", "column_name")
    schemas = [quality.schema_check(df, table, RAW_SCHEMAS[table]).where("status = 'MISSING'") for table, df in bronze.items() if table in RAW_SCHEMAS]
    parts = [_problem(errors.SCHEMA_MISMATCH, df, name, F.concat(F.lit("column of type "), "expected_type", F.lit(" is missing"))) for df in schemas]
    nulls = [quality.quality_check(df, table, K.EXPECTED_COLUMNS.get(table, ())).where("issue = 'HIGH NULLS'") for table, df in bronze.items()]
    parts += [_problem(errors.HIGH_NULL_RATE, df, name, F.format_string("%.1f%% nulls", "null_pct")) for df in nulls]
    return reduce(DataFrame.unionByName, parts)


def silver_problems(silver: DataFrame) -> DataFrame:
    """Lookups that left claims with a key without a row."""
    found = quality.join_null_check(silver, LOOKUPS).where("unmatched > 0")
    return _problem(errors.JOIN_NULLS, found, "column_name", F.format_string("%d of %d keys found no row", "unmatched", "keyed"))


def gold_problems(gold: DataFrame) -> DataFrame:
    """Features without any value, and labels that are nearly all alike."""
    empty = quality.all_null_check(gold).where("all_null")
    extreme = features.label_distribution(gold).where("status = 'EXTREME'")
    return _problem(errors.FEATURE_ALL_NULL, empty, "column_name", F.lit("no value at all")).unionByName(
        _problem(errors.LABEL_IMBALANCE, extreme, F.lit(K.TARGET), F.format_string("%.1f%% denied", "denial_rate_pct")))


def _announce(problems: DataFrame, written: list[DataFrame], strict: bool) -> None:
    """Keeps the problems of a layer, and ends a strict run at the first fatal one, in order of code and subject."""
    kept = stage(problems, "layer-problems")
    written.append(kept)
    if strict and (first := kept.where(F.col("code").isin(*FATAL)).orderBy("code", "subject").first()):
        raise errors.ClaimLensError(first["code"], f"{first['subject']}: {first['detail']}")


def run_layers(spark: SparkSession, bronze_dir: str, out_dir: str, strict: bool | None = None, **options) -> dict[str, str]:
    """Bronze tables to written Silver, validated Silver and Gold; returns the paths.

    With ``strict`` given, each layer is checked before the next one is built, and the table ``layer_problems`` (code, subject,
    detail) is written beside the layers; a true value makes a fatal problem a coded error.
    """
    names = ("bronze_claims", "bronze_providers", "bronze_diagnosis", "bronze_cost")
    bronze = {n: tables.load_bronze(spark, bronze_dir, n) for n in names}
    paths = {n: f"{out_dir}/{n}" for n in ("silver_claims", "silver_claims_validated", "gold_features")}
    problems: list[DataFrame] = []
    if strict is not None:
        _announce(bronze_problems(bronze), problems, strict)
    tables.write_layer(build_silver(bronze, **options), paths["silver_claims"])
    silver = spark.read.parquet(paths["silver_claims"])
    if strict is not None:
        _announce(silver_problems(silver), problems, strict)
    tables.write_layer(rules.apply_validation_rules(silver), paths["silver_claims_validated"])
    validated = spark.read.parquet(paths["silver_claims_validated"])
    tables.write_layer(features.gold_features(validated), paths["gold_features"])
    if strict is not None:
        _announce(gold_problems(spark.read.parquet(paths["gold_features"])), problems, strict)
        paths["layer_problems"] = tables.write_layer(reduce(DataFrame.unionByName, problems), f"{out_dir}/layer_problems")
    return paths
