"""Cleaning of the four Bronze tables. Keeps incomplete rows; only repeated claim ids go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import numbers, text
from ..functions.text import normal_name

# Column with the place of a row in its source, if the reader gave one.
POSITION = "source_position"
# Which of several rows with one claim_id is "first": the one that stands first in the source. Rows without a position
# are ordered by value; every remaining column follows, which makes the survivor unambiguous.
CLAIM_ORDER = (
    "claim_date", "date", "provider_id", "diagnosis_code", "procedure_code", "billed_amount",
)


CODES = ("diagnosis_code", "procedure_code")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Header names stripped, lower case, blanks as underscores."""
    return df.toDF(*map(normal_name, df.columns))


def dedup_keep_first(
    df: DataFrame, key: str = "claim_id", order: Sequence[str] = CLAIM_ORDER
) -> DataFrame:
    """One row per key: the first in the source, if ``source_position`` tells, else the first by value. The position is
    dropped. A null key is a key like any other.

    Catalyst turns ``row_number() = 1`` into a group limit that also runs before the shuffle, so a
    key holding a large share of the table leaves each map task as a single row.
    """
    leading = [c for c in (POSITION, *order) if c in df.columns]
    rest = sorted(c for c in df.columns if c != key and c not in leading)
    first = Window.partitionBy(key).orderBy(*[F.asc_nulls_last(c) for c in (*leading, *rest)])
    return df.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn", POSITION)


def parse_date(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text column ``date`` becomes timestamp ``claim_date``; unparseable text becomes null."""
    if "date" not in df.columns:
        return df
    return df.withColumn("claim_date", numbers.to_timestamp("date", fmt)).drop("date")


def standardize_codes(
    df: DataFrame, columns: Sequence[str] = CODES, empty_as_null: bool = False
) -> DataFrame:
    """Codes stripped and upper case. With ``empty_as_null`` a blank code counts as missing."""
    present = [c for c in columns if c in df.columns]
    fixed = {c: text.code(c) for c in present}
    if empty_as_null:
        fixed = {c: F.nullif(e, F.lit("")) for c, e in fixed.items()}
    return df.withColumns(fixed) if fixed else df


def strip_strings(df: DataFrame, skip: Sequence[str] = ()) -> DataFrame:
    """Every string column stripped of Unicode whitespace, but for those in ``skip``."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in skip]
    return df.withColumns({c: text.strip(c) for c in strings}) if strings else df


def fill_unknown(df: DataFrame, column: str = "location", value: str = "Unknown") -> DataFrame:
    return df.withColumn(column, F.coalesce(F.col(column), F.lit(value)))


def coerce_numeric(df: DataFrame, columns: Sequence[str] = ("average_cost", "expected_cost")) -> DataFrame:
    return df.withColumns({c: numbers.to_double(c) for c in columns})


def clean_claims(df: DataFrame, date_format: str = "yyyy-MM-dd", empty_as_null: bool = False) -> DataFrame:
    """Bronze claims to clean claims: one row per claim id, typed date, normal codes."""
    return (
        df.transform(normalize_columns)
        .transform(dedup_keep_first)
        .transform(parse_date, date_format)
        .transform(standardize_codes, CODES, empty_as_null)
        .transform(strip_strings, CODES)
    )


def clean_providers(df: DataFrame) -> DataFrame:
    return df.transform(normalize_columns).transform(fill_unknown).transform(strip_strings)


def clean_diagnosis(df: DataFrame) -> DataFrame:
    df = df.transform(normalize_columns).transform(standardize_codes, ("diagnosis_code",))
    return df.withColumns({c: text.strip(c) for c in ("category", "severity")})


def clean_cost(df: DataFrame) -> DataFrame:
    return (
        df.transform(normalize_columns)
        .transform(standardize_codes, ("procedure_code",))
        .transform(coerce_numeric)
    )


def cleaning_counts(raw: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """What cleaning will drop or null out, in one pass over the raw claims."""
    raw = normalize_columns(raw)
    keys = F.count_distinct("claim_id") + F.max(F.col("claim_id").isNull().cast("long"))
    return raw.agg(
        F.count(F.lit(1)).alias("rows"),
        (F.count(F.lit(1)) - keys).alias("duplicates"),
        F.count_if(numbers.to_timestamp("date", date_format).isNull()).alias("dates_null"),
    ).na.fill(0)
