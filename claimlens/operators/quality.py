"""Quality checks over Bronze tables, and the checks the error catalogue announces."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from ..functions.numbers import py_round
from .profile import null_counts

_ISSUES = "table_name string, column_name string, issue string, null_pct double"


def quality_check(
    df: DataFrame, table: str, expected: Sequence[str], threshold_pct: float = K.NULL_WARN_PCT
) -> DataFrame:
    """Issue rows: expected columns that are absent or whose null share exceeds the threshold."""
    present = [c for c in expected if c in df.columns]
    absent = [(table, c, "COLUMN MISSING", None) for c in expected if c not in df.columns]
    issues = df.sparkSession.createDataFrame(absent, _ISSUES)
    if present:
        pct = F.col("missing") / F.nullif(F.col("_rows"), F.lit(0)) * 100
        high = null_counts(df.select(*present)).where(pct > threshold_pct).select(
            F.lit(table).alias("table_name"),
            "column_name",
            F.lit("HIGH NULLS").alias("issue"),
            py_round(pct, 1).alias("null_pct"),
        )
        issues = issues.unionByName(high)
    return issues


def issue_text(issues: DataFrame) -> DataFrame:
    """Issues in the wording of the quality report."""
    missing = F.format_string("[%s] COLUMN MISSING: '%s'", "table_name", "column_name")
    nulls = F.format_string("[%s] HIGH NULLS in '%s': %.1f%%", "table_name", "column_name", "null_pct")
    return issues.select(F.when(F.col("issue") == "COLUMN MISSING", missing).otherwise(nulls).alias("issue"))


def quality_summary(
    tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]] = K.EXPECTED_COLUMNS,
    threshold_pct: float = K.NULL_WARN_PCT,
) -> DataFrame:
    """One row per table: rows, columns, nulls over all columns and number of issues.

    Each table is scanned once; its issue count comes from the same null counts.
    """
    parts = []
    for name, df in tables.items():
        wanted = list(expected.get(name, ()))
        absent = len([c for c in wanted if c not in df.columns])
        pct = F.col("missing") / F.nullif(F.col("_rows"), F.lit(0)) * 100
        parts.append(null_counts(df).agg(
            F.max("_rows").alias("row_count"),
            F.sum("missing").alias("total_nulls"),
            (F.count_if(F.col("column_name").isin(*wanted) & (pct > threshold_pct)) + absent).alias("issues"),
        ).select(F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).alias("column_count"),
                 "total_nulls", "issues"))
    return reduce(DataFrame.unionByName, parts)


def all_issues(
    tables: Mapping[str, DataFrame], expected: Mapping[str, Sequence[str]] = K.EXPECTED_COLUMNS
) -> DataFrame:
    return reduce(
        DataFrame.unionByName, [quality_check(df, name, expected.get(name, ())) for name, df in tables.items()]
    )


def quality_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The quality summary as text lines: per-table blocks, then the issues."""
    order = F.create_map(*[x for i, t in enumerate(tables) for x in (F.lit(t), F.lit(i))])
    blocks = quality_summary(tables).select(
        F.element_at(order, F.col("table_name")).alias("position"),
        F.format_string(
            "Table   : %s\n  Rows          : %,d\n  Columns       : %d\n  Total nulls   : %,d\n  Issues found  : %d\n",
            "table_name", "row_count", "column_count", "total_nulls", "issues",
        ).alias("line"),
    )
    issues = issue_text(all_issues(tables)).select(
        F.lit(len(tables) + 1).alias("position"), F.concat(F.lit("  ⚠  "), F.col("issue")).alias("line")
    )
    none = issues.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(
        F.lit(len(tables) + 2).alias("position"), F.lit("  ✓  No critical issues found.").alias("line")
    )
    spark: SparkSession = next(iter(tables.values())).sparkSession
    titles = spark.createDataFrame(
        [(-1, "DATA QUALITY SUMMARY — ALL BRONZE TABLES\n"), (len(tables), "--- Issues Requiring Attention ---")],
        "position int, line string",
    )
    return reduce(DataFrame.unionByName, [titles, blocks, issues, none])


def schema_check(df: DataFrame, table: str, schema: StructType) -> DataFrame:
    """Declared columns with what the table has: OK, MISSING or TYPE MISMATCH, and its row count."""
    actual = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = []
    for field in schema.fields:
        want, have = field.dataType.simpleString(), actual.get(field.name)
        status = "MISSING" if have is None else "OK" if have == want else "TYPE MISMATCH"
        rows.append(F.struct(F.lit(field.name).alias("column_name"), F.lit(want).alias("expected_type"),
                             F.lit(have).alias("actual_type"), F.lit(status).alias("status")))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table_name"), "row_count", F.inline(F.array(*rows))
    )


def join_null_check(enriched: DataFrame, lookups: Mapping[str, str]) -> DataFrame:
    """Per joined column the claims that have a key but found no reference row.

    ``lookups`` maps each joined column to its key column. One pass over the table.
    """
    counts = enriched.agg(*[
        F.struct(
            F.lit(column).alias("column_name"),
            F.count_if(F.col(key).isNotNull()).alias("keyed"),
            F.count_if(F.col(key).isNotNull() & F.col(column).isNull()).alias("unmatched"),
        ).alias(column)
        for column, key in lookups.items()
    ])
    return counts.select(F.inline(F.array(*[F.col(c) for c in lookups])))


def all_null_check(df: DataFrame, columns: Sequence[str] = K.FEATURES) -> DataFrame:
    """Per feature whether it holds no value at all."""
    counts = null_counts(df.select(*columns))
    return counts.select(
        "column_name", "missing", ((F.col("_rows") > 0) & (F.col("missing") == F.col("_rows"))).alias("all_null")
    )
