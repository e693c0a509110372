"""Left joins of claims with their reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROVIDER_COLUMNS = ("doctor_name", "specialty", "location")
DIAGNOSIS_COLUMNS = ("category", "severity")
COST_COLUMNS = ("average_cost", "expected_cost")


def left_lookup(
    claims: DataFrame,
    reference: DataFrame,
    key: str,
    columns: Sequence[str],
    null_safe: bool = False,
    dedup_reference: bool = False,
) -> DataFrame:
    """Add ``columns`` of ``reference`` to every claim; claims without a match get nulls.

    A reference key that occurs twice repeats its claims, as a left join does; ``dedup_reference``
    keeps one reference row per key instead. ``null_safe`` lets a null key match a null key.
    Spark broadcasts the reference if its bytes are few enough by the session's threshold.
    """
    ref = reference.select(key, *columns)
    if dedup_reference:
        ref = ref.groupBy(key).agg(F.min(F.struct(*columns)).alias("_r")).select(key, "_r.*")
    if not null_safe:
        return claims.join(ref, key, "left")
    ref = ref.withColumnRenamed(key, "_key")
    return claims.join(ref, claims[key].eqNullSafe(ref["_key"]), "left").drop("_key")


def enrich_providers(claims: DataFrame, providers: DataFrame, **options) -> DataFrame:
    return left_lookup(claims, providers, "provider_id", PROVIDER_COLUMNS, **options)


def enrich_diagnosis(claims: DataFrame, diagnosis: DataFrame, **options) -> DataFrame:
    return left_lookup(claims, diagnosis, "diagnosis_code", DIAGNOSIS_COLUMNS, **options)


def enrich_cost(claims: DataFrame, cost: DataFrame, **options) -> DataFrame:
    return left_lookup(claims, cost, "procedure_code", COST_COLUMNS, **options)


def enrich_claims(
    claims: DataFrame, providers: DataFrame, diagnosis: DataFrame, cost: DataFrame, **options
) -> DataFrame:
    return (
        claims.transform(enrich_providers, providers, **options)
        .transform(enrich_diagnosis, diagnosis, **options)
        .transform(enrich_cost, cost, **options)
    )
