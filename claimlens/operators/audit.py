"""Provider audits: denial tiers, audit triggers, billing notices and volume, over validated claims.

Claims are first counted per provider and day, combined before the shuffle, so a provider with a third of all claims is
one row per day in the range frames that follow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K


def _has(flag: str) -> Column:
    return F.array_contains(F.split("validation_flags", r"\|"), flag)


def provider_days(claims: DataFrame) -> DataFrame:
    """Claims, flagged claims, high billings and incomplete claims per provider and day, and the largest cost multiple.

    ``day`` is the number of days since 1970-01-01, null for claims without a date. Claims without a provider are left out.
    """
    multiple = F.when(F.col("expected_cost") > 0, F.col("billed_amount") / F.col("expected_cost"))
    return claims.where("provider_id is not null").groupBy("provider_id", F.unix_date(F.to_date("claim_date")).alias("day")).agg(
        F.count(F.lit(1)).alias("claims"), F.count_if(F.col("validation_flags") != "").alias("flagged"),
        F.count_if(_has("WARN_HIGH_BILLING")).alias("high"), F.count_if(_has("ERR_INCOMPLETE_CLAIM")).alias("incomplete"),
        F.max(multiple).alias("multiple"))


def _last(days: int) -> Window:
    return Window.partitionBy("provider_id").orderBy("day").rangeBetween(-(days - 1), 0)


def _any(condition: Column) -> Column:
    return F.coalesce(F.bool_or(condition), F.lit(False))


def provider_tier(claims: DataFrame) -> DataFrame:
    """Share of flagged claims per provider and its tier."""
    totals = provider_days(claims).groupBy("provider_id").agg(F.sum("claims").alias("claims"), (F.sum("flagged") / F.sum("claims")).alias("denial_rate"))
    rate = F.col("denial_rate")
    return totals.withColumn("tier", F.when(rate < K.AUDIT_ELEVATED_RATE, "NORMAL").when(rate <= K.AUDIT_HIGH_RATE, "ELEVATED").otherwise("HIGH RISK"))


def audit_trigger(claims: DataFrame) -> DataFrame:
    """Per provider which conditions of an audit hold, and whether any does. Days without a date have no window."""
    days = provider_days(claims)
    share = F.sum("flagged").over(_last(K.AUDIT_RATE_DAYS)) / F.sum("claims").over(_last(K.AUDIT_RATE_DAYS))
    dated = F.col("day").isNotNull()
    seen = days.select(
        "provider_id", (F.col("multiple") > K.AUDIT_COST_MULTIPLE).alias("cost"), (dated & (share > K.AUDIT_HIGH_RATE)).alias("rate"),
        (dated & (F.sum("high").over(_last(K.AUDIT_COUNT_DAYS)) > K.AUDIT_HIGH_BILLINGS)).alias("high"),
        (dated & (F.sum("incomplete").over(_last(K.AUDIT_COUNT_DAYS)) > K.AUDIT_INCOMPLETE)).alias("incomplete"))
    found = seen.groupBy("provider_id").agg(
        _any(F.col("rate")).alias("denial_rate_90d"), _any(F.col("high")).alias("high_billing_30d"),
        _any(F.col("incomplete")).alias("incomplete_30d"), _any(F.col("cost")).alias("single_claim"))
    return found.withColumn("triggered", F.expr("denial_rate_90d or high_billing_30d or incomplete_30d or single_claim"))


def high_billing_notice(claims: DataFrame) -> DataFrame:
    """Per provider the largest share of high billings in any 90 days, and whether it earns a notice."""
    days = provider_days(claims).where("day is not null")
    share = F.sum("high").over(_last(K.AUDIT_RATE_DAYS)) / F.sum("claims").over(_last(K.AUDIT_RATE_DAYS))
    return days.select("provider_id", share.alias("share")).groupBy("provider_id").agg(F.max("share").alias("high_billing_rate")).withColumn(
        "notice", F.col("high_billing_rate") > K.NOTICE_HIGH_BILLING_RATE)


def high_volume_provider(claims: DataFrame) -> DataFrame:
    """Provider and month of more than a hundred claims."""
    days = provider_days(claims).where("day is not null")
    month = F.date_format(F.date_from_unix_date("day"), "yyyy-MM").alias("month")
    return days.groupBy("provider_id", month).agg(F.sum("claims").alias("claims")).where(F.col("claims") > K.HIGH_VOLUME_CLAIMS)
