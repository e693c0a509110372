"""Headline numbers over claims and the prediction history."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import fixed, to_timestamp


def kpi_summary(claims: DataFrame, approx: bool = False) -> DataFrame:
    providers = F.approx_count_distinct("provider_id") if approx else F.count_distinct("provider_id")
    return claims.agg(
        F.count(F.lit(1)).alias("total_claims"),
        F.coalesce(F.sum("billed_amount"), F.lit(0.0)).alias("total_billed_amount"),
        providers.alias("unique_providers"),
    )


def join_claims_providers(claims: DataFrame, providers: DataFrame) -> DataFrame:
    """All columns of both; columns other than the key that both have get the suffixes _x and _y."""
    shared = [c for c in providers.columns if c in claims.columns and c != "provider_id"]
    left = claims.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = providers.withColumnsRenamed({c: f"{c}_y" for c in shared})
    return left.join(right, "provider_id", "left")


def provider_activity(claims: DataFrame, providers: DataFrame, limit: int = 10) -> DataFrame:
    """Doctors with most claims. Claims are counted per provider before the join, which then carries
    one row per provider instead of one per claim."""
    per_provider = claims.groupBy("provider_id").agg(F.count(F.lit(1)).alias("_n"))
    return (
        per_provider.join(providers.select("provider_id", "doctor_name"), "provider_id")
        .where(F.col("doctor_name").isNotNull())
        .groupBy("doctor_name")
        .agg(F.sum("_n").alias("claim_count"))
        .orderBy(F.desc("claim_count"), "doctor_name")
        .limit(limit)
    )


def claims_trend(claims: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Billed amount per day, ascending; claims without a readable date are left out."""
    if "claim_date" in claims.columns:
        day = F.to_date("claim_date")
    elif "date" in claims.columns:
        day = to_timestamp("date", date_format).cast("date")
    else:
        return claims.sparkSession.createDataFrame([], "date_parsed string, billed_amount double")
    return (
        claims.select(day.alias("_day"), "billed_amount")
        .where(F.col("_day").isNotNull())
        .groupBy("_day")
        .agg(F.coalesce(F.sum("billed_amount"), F.lit(0.0)).alias("billed_amount"))
        .orderBy("_day")
        .select(F.col("_day").cast("string").alias("date_parsed"), "billed_amount")
    )


def history_latest(
    history: DataFrame, username: str, is_admin: bool = False, limit: int = K.HISTORY_LIMIT
) -> DataFrame:
    """Newest scored claims of a user, of everybody for an administrator."""
    rows = history if is_admin else history.where(F.col("username") == username)
    return (
        rows.orderBy(F.desc("submitted_at"), F.desc("id"))
        .limit(limit)
        .withColumn("is_denied", F.col("is_denied") == 1)
        .withColumnRenamed("username", "submitted_by")
    )


def history_display(history: DataFrame, is_admin: bool = False) -> DataFrame:
    """History rows as shown to people: percent, status and minute-precision time as text."""
    pct = F.when(
        F.col("denial_probability").isNotNull(), F.concat(fixed(F.col("denial_probability") * 100, 1), F.lit("%"))
    )
    shown = history.withColumns({
        "denial_probability": F.coalesce(pct, F.lit(K.NO_PROBABILITY_TEXT)),
        "is_denied": F.when(F.col("is_denied"), K.DENIED_TEXT).otherwise(K.CLEAN_TEXT),
        "submitted_at": F.coalesce(F.date_format("submitted_at", "yyyy-MM-dd HH:mm"), F.lit("")),
    })
    columns = ["claim_id", "patient_id", "provider_id", "billed_amount", "diagnosis_code", "procedure_code",
               "risk_level", "denial_probability", "is_denied", "flags"]
    columns += ["submitted_by", "submitted_at"] if is_admin else ["submitted_at"]
    return shown.select(*[c for c in columns if c in shown.columns])
