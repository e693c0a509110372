"""The decision taken on submitted claims, for whole tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import py_round, true_or_false


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


def serving_features(claims: DataFrame) -> DataFrame:
    """Model inputs derived from the submitted fields alone.

    Features that stay null are left to the model's medians.
    """
    high = true_or_false(F.col("billed_amount") > K.SERVING_HIGH_AMOUNT)
    missing = (
        _blank("diagnosis_code").cast("int") + _blank("procedure_code").cast("int")
        + F.col("billed_amount").isNull().cast("int")
    )
    return claims.withColumns({
        "is_high_biller": high.cast("double"),
        "claim_amount_ratio": F.when(high, K.SERVING_RATIO_HIGH).otherwise(K.SERVING_RATIO_NORMAL),
        "missing_fields_count": missing.cast("double"),
        "diagnosis_severity_flag": F.when(_blank("diagnosis_code"), 1.0),
        "provider_denial_rate": F.when((missing > 0) | high, K.SERVING_PROVIDER_RATE),
        "provider_claim_count": F.lit(None).cast("double"),
        "claim_month": F.lit(None).cast("double"),
    })


def strict_override(scored: DataFrame) -> DataFrame:
    """In strict mode (default) a claim with a gap or a high amount is denied at a set probability."""
    strict = F.coalesce(F.col("strict_mode"), F.lit(True)) if "strict_mode" in scored.columns else F.lit(True)
    high = F.col("is_high_biller") == 1.0
    base = F.when(F.col("missing_fields_count") == 1, K.OVERRIDE_ONE_MISSING).otherwise(K.OVERRIDE_OTHER)
    base = F.when(high, F.greatest(base, F.lit(K.OVERRIDE_HIGH_BILLER_FLOOR))).otherwise(base)
    hit = strict & (high | (F.col("missing_fields_count") > 0))
    return scored.withColumns({
        "probability": F.when(hit, base).otherwise(F.col("probability")),
        "predicted_label": F.when(hit, 1).otherwise(F.col("predicted_label")),
        "risk_level": F.when(hit, "HIGH").otherwise(F.col("risk_level")),
    })


def risk_level(probability: Column | str = "probability") -> Column:
    p = F.col(probability) if isinstance(probability, str) else probability
    return F.when(p >= K.RISK_HIGH, "HIGH").when(p >= K.RISK_MEDIUM, "MEDIUM").otherwise("LOW")


def decide(scored: DataFrame, threshold: float, raw: str = "raw_probability") -> DataFrame:
    """Label and level from the clamped probability, which is rounded only afterwards."""
    clamped = F.least(F.greatest(F.col(raw), F.lit(0.0)), F.lit(1.0))
    return scored.withColumn("_p", clamped).withColumns({
        "predicted_label": (F.col("_p") >= threshold).cast("int"),
        "risk_level": risk_level("_p"),
        "probability": py_round("_p", 4),
        "threshold": F.lit(float(threshold)),
    }).drop("_p")


def canned_contributions(scored: DataFrame) -> DataFrame:
    """Adds ``feature_contributions`` from ``flags`` and ``probability``: fixed texts, with a fallback
    for a claim without any of them that is still somewhat risky."""
    def entry(feature: str, score: str, suggestion: str) -> Column:
        return F.struct(F.lit(feature).alias("feature"), F.lit(score).alias("score"), F.lit(suggestion).alias("suggestion"))

    known = [(flag, entry(*texts)) for flag, *texts in K.CONTRIBUTIONS if flag]
    fallback = next(entry(*texts) for flag, *texts in K.CONTRIBUTIONS if flag is None)
    fired = F.array_compact(F.array(*[F.when(F.array_contains("flags", flag), e) for flag, e in known]))
    risky = true_or_false(F.col("probability") > K.CONTRIBUTION_FALLBACK_ABOVE)
    return scored.withColumn(
        "feature_contributions", F.when((F.size(fired) == 0) & risky, F.array(fallback)).otherwise(fired)
    )


def history_rows(decided: DataFrame, username: Column | str) -> DataFrame:
    """Scored claims in the shape of the prediction history."""
    user = F.lit(username) if isinstance(username, str) else username
    return decided.select(
        user.alias("username"), "claim_id", "patient_id", "provider_id", "billed_amount", "diagnosis_code",
        "procedure_code", F.col("probability").alias("denial_probability"), "risk_level",
        (F.col("predicted_label") == 1).cast("int").alias("is_denied"), F.array_join("flags", "|").alias("flags"),
        F.current_timestamp().alias("submitted_at"),
    )
