"""Gold features, risk score and the synthetic denial label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import np_round, true_or_false, unit_hash
from ..session import stage
from .rules import billed_over


def add_claim_amount_ratio(df: DataFrame) -> DataFrame:
    ratio = F.when(F.col("expected_cost") > 0, F.col("billed_amount") / F.col("expected_cost"))
    return df.withColumn("claim_amount_ratio", ratio)


def provider_stats(df: DataFrame) -> DataFrame:
    """Claims and share of flagged claims per provider; claims without a provider are left out.

    A plain aggregate, combined before the shuffle: a provider with a third of all claims costs each
    map task one row, where a window would put that third into one task.
    """
    flagged = (F.col("validation_flags") != "").cast("int")
    return (
        df.where(F.col("provider_id").isNotNull())
        .groupBy("provider_id")
        .agg(
            F.count("claim_id").alias("provider_claim_count"),
            np_round(F.avg(flagged), 4).alias("provider_denial_rate"),
        )
    )


def add_provider_features(df: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Every claim with its provider's totals, null where the claim names no provider.

    The per-provider table is staged, so Spark knows its bytes: it is broadcast below the session's threshold and
    otherwise joined by a shuffle whose hot provider AQE splits on the claims side.
    """
    stats = stage(provider_stats(df), "provider-stats") if stats is None else stats
    return df.join(stats, "provider_id", "left")


def add_diagnosis_severity_flag(df: DataFrame) -> DataFrame:
    high = true_or_false(F.col("severity") == "High")
    return df.withColumn("diagnosis_severity_flag", high.cast("byte"))


def add_missing_fields_count(df: DataFrame) -> DataFrame:
    missing = [F.col(c).isNull().cast("int") for c in ("diagnosis_code", "procedure_code", "billed_amount")]
    return df.withColumn("missing_fields_count", (missing[0] + missing[1] + missing[2]).cast("byte"))


def add_is_high_biller(df: DataFrame) -> DataFrame:
    return df.withColumn("is_high_biller", billed_over(K.HIGH_BILLER_MULTIPLIER).cast("byte"))


def add_claim_month(df: DataFrame) -> DataFrame:
    month = F.month("claim_date") if "claim_date" in df.columns else F.lit(None).cast("int")
    return df.withColumn("claim_month", month)


def risk_score(df: DataFrame) -> Column:
    """Weighted sum of the flags that the table has."""
    score = F.lit(0)
    for flag, _, weight in K.RULES:
        if flag in df.columns:
            score = score + F.col(flag).cast("int") * weight
    return score.cast("short")


def add_denial_label(df: DataFrame, noise: float = K.LABEL_NOISE_RATE) -> DataFrame:
    """Risk score and label: denied from a score of 3 on, flipped for a share of claims.

    Which claims flip depends on a hash of the claim id, so the label does not change with row order
    or partitioning.
    """
    df = df.withColumn("risk_score", risk_score(df))
    denied = (F.col("risk_score") >= K.DENIAL_SCORE).cast("int")
    flip = true_or_false(unit_hash("claim_id") < int(noise * 10_000))
    return df.withColumn(K.TARGET, F.when(flip, 1 - denied).otherwise(denied).cast("byte"))


def gold_projection(df: DataFrame) -> DataFrame:
    """The Gold columns in their fixed order, without those the input lacks."""
    return df.select(*[c for c in K.GOLD_COLUMNS if c in df.columns])


def gold_features(validated: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Validated Silver claims to the Gold table.

    Pass a ``validated`` table that is already written: it is read twice, for the provider totals
    and for the rows.
    """
    return (
        validated.transform(add_claim_amount_ratio)
        .transform(add_provider_features, stats)
        .transform(add_diagnosis_severity_flag)
        .transform(add_missing_fields_count)
        .transform(add_is_high_biller)
        .transform(add_claim_month)
        .transform(add_denial_label)
        .transform(gold_projection)
    )


def label_distribution(gold: DataFrame) -> DataFrame:
    """Denied claims, their share in percent and whether the share is too extreme to train on."""
    denied, rate = F.sum(K.TARGET), F.avg(F.col(K.TARGET).cast("int")) * 100
    return gold.agg(
        F.coalesce(denied, F.lit(0)).cast("long").alias("denied"),
        F.round(rate, 4).alias("denial_rate_pct"),
        F.when((rate > 95) | (rate < 5), "EXTREME").otherwise("OK").alias("status"),
    )
