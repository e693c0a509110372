"""Validation rules as data: each is a flag column, a label, a weight and a predicate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import py_round, true_or_false


@dataclass(frozen=True)
class Rule:
    flag: str
    label: str
    weight: int
    predicate: Callable[[], Column]


def _missing(column: str) -> Callable[[], Column]:
    return lambda: F.col(column).isNull()


def billed_over(multiplier: float) -> Column:
    """Billed more than ``multiplier`` times the expected cost, both known."""
    return true_or_false(F.col("billed_amount") > multiplier * F.col("expected_cost"))


_PREDICATES: dict[str, Callable[[], Column]] = {
    "flag_missing_diagnosis": _missing("diagnosis_code"),
    "flag_missing_procedure": _missing("procedure_code"),
    "flag_missing_amount": _missing("billed_amount"),
    "flag_high_billing": lambda: billed_over(K.HIGH_BILLING_MULTIPLIER),
    "flag_invalid_diagnosis": lambda: true_or_false(~F.col("diagnosis_code").isin(*K.VALID_DIAGNOSIS_CODES)),
    "flag_incomplete_claim": lambda: F.col("diagnosis_code").isNull() & F.col("procedure_code").isNull(),
}

BATCH_RULES = tuple(Rule(flag, label, weight, _PREDICATES[flag]) for flag, label, weight in K.RULES)


def _blank(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")) == ""


# Requests use their own rules: an empty code is missing, the amount limit is flat, no code check.
REQUEST_RULES = (
    Rule("flag_missing_diagnosis", "WARN_MISSING_DIAGNOSIS", 2, lambda: _blank("diagnosis_code")),
    Rule("flag_missing_procedure", "WARN_MISSING_PROCEDURE", 2, lambda: _blank("procedure_code")),
    Rule("flag_missing_amount", "WARN_MISSING_AMOUNT", 1, _missing("billed_amount")),
    Rule("flag_high_billing", "WARN_HIGH_BILLING", 2,
         lambda: true_or_false(F.col("billed_amount") > K.SERVING_HIGH_AMOUNT)),
    Rule("flag_incomplete_claim", "ERR_INCOMPLETE_CLAIM", 3,
         lambda: _blank("diagnosis_code") & _blank("procedure_code")),
)


def add_flags(df: DataFrame, rules: tuple[Rule, ...] = BATCH_RULES) -> DataFrame:
    """One boolean column per rule, never null."""
    return df.withColumns({r.flag: r.predicate() for r in rules})


def fired_labels(rules: tuple[Rule, ...] = BATCH_RULES) -> list[Column]:
    """Per rule its label where its flag column is set, else null."""
    return [F.when(F.col(r.flag), F.lit(r.label)) for r in rules]


def add_validation_flags(df: DataFrame, rules: tuple[Rule, ...] = BATCH_RULES) -> DataFrame:
    """Labels of the fired rules in rule order, joined by ``|``; empty text for a clean claim."""
    return df.withColumn("validation_flags", F.concat_ws("|", *fired_labels(rules)))


def apply_validation_rules(df: DataFrame, rules: tuple[Rule, ...] = BATCH_RULES) -> DataFrame:
    return df.transform(add_flags, rules).transform(add_validation_flags, rules)


def request_flags(df: DataFrame) -> DataFrame:
    """Flags of a serving request as an array of labels in rule order.

    The few possible arrays are constants, picked by the number whose bits are the rules that fire: no array is built per
    row, and no lambda keeps the projection out of generated code.
    """
    count = len(REQUEST_RULES)
    lists = [[r.label for i, r in enumerate(REQUEST_RULES) if fired >> i & 1] for fired in range(1 << count)]
    options = F.array(*[F.array(*map(F.lit, labels)).cast("array<string>") for labels in lists])
    fired = reduce(Column.__add__, [F.when(r.predicate(), 1 << i).otherwise(0) for i, r in enumerate(REQUEST_RULES)])
    return df.withColumn("flags", F.get(options, fired))


def flagged_count(validated: DataFrame) -> DataFrame:
    return validated.agg(
        F.count_if(F.col("validation_flags") != "").alias("flagged"),
        F.count(F.lit(1)).alias("total"),
    )


def validation_summary(validated: DataFrame, rules: tuple[Rule, ...] = BATCH_RULES) -> DataFrame:
    """Rows ``(rule, count, pct_of_claims)``, one per rule and one for clean claims.

    All counts come from one pass with partial aggregation; the single result row is then unpivoted.
    """
    present = [r for r in rules if r.flag in validated.columns]
    counts = validated.agg(
        F.count(F.lit(1)).alias("_total"),
        *[F.count_if(F.col(r.flag)).alias(r.label) for r in present],
        F.count_if(F.col("validation_flags") == "").alias("CLEAN"),
    )
    rows = counts.unpivot("_total", [*[r.label for r in present], "CLEAN"], "rule", "claims")
    pct = F.when(F.col("_total") > 0, py_round(F.col("claims") / F.nullif("_total", F.lit(0)) * 100, 1))
    return rows.select("rule", "claims", pct.alias("pct_of_claims"))
