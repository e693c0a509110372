"""Table profiles as long tables, and their text rendering."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType

from ..functions.numbers import np_round, to_timestamp
from .quantiles import number, quantiles_and

# Tables whose jobs run at once.
_AT_ONCE = 4
NUMERIC_STATS = ("count", "mean", "std", "min", "25%", "50%", "75%", "max")


def _unpivot(one_row: DataFrame, columns: Sequence[str], value_type: str, value: str) -> DataFrame:
    """A one-row table with one aggregate per column as rows ``(column_name, value)``."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast(value_type).alias(value)) for c in columns
    ])
    return one_row.select("_rows", F.inline(pairs))


def profile_shape(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(name).alias("table_name"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(", ".join(df.columns)).alias("column_names"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """Rows ``(_rows, column_name, missing)`` for every column, from one aggregate."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns]
    )
    return _unpivot(counts, df.columns, "long", "missing")


def profile_missing(df: DataFrame) -> DataFrame:
    """Columns that have nulls, with count and percentage."""
    return null_counts(df).where("missing > 0").select(
        "column_name",
        "missing",
        np_round(F.col("missing") / F.col("_rows") * 100, 2).alias("missing_pct"),
    )


def profile_duplicates(df: DataFrame, key: str = "claim_id") -> DataFrame:
    """Rows whose key occurred before; null counts as one key value."""
    null_key = F.coalesce(F.max(F.col(key).isNull().cast("long")), F.lit(0))
    return df.agg(
        (F.count(F.lit(1)) - F.count_distinct(key) - null_key).cast("long").alias("duplicates")
    )


def date_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if "date" in c.lower()]


def _as_time(df: DataFrame, column: str, date_format: str) -> Column:
    if isinstance(df.schema[column].dataType, StringType):
        return to_timestamp(column, date_format)
    return F.col(column).try_cast("timestamp")


def profile_date_range(df: DataFrame, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Earliest and latest value and number of unreadable values of every date column."""
    columns = date_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, min_date timestamp, max_date timestamp, invalid long")
    aggs = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.min(_as_time(df, c, date_format)).alias("min_date"),
            F.max(_as_time(df, c, date_format)).alias("max_date"),
            F.count_if(_as_time(df, c, date_format).isNull()).alias("invalid"),
        ).alias(c)
        for c in columns
    ]
    return df.agg(*aggs).select(F.inline(F.array(*[F.col(f"`{c}`") for c in columns])))


def distinct_counts(df: DataFrame) -> DataFrame:
    """Rows ``(column_name, distinct_values)``: distinct non-null values of every column.

    A value travels as two 64-bit hashes next to its column's number, whatever its length, and repeats are
    dropped in the task that read them. Values count as equal if both hashes are.
    """
    pairs = F.array(*[
        F.when(F.col(f"`{c}`").isNotNull(), F.struct(
            F.lit(i).alias("i"), F.xxhash64(F.col(f"`{c}`")).alias("h"), F.xxhash64(F.lit(i), F.col(f"`{c}`"), F.lit("again")).alias("g")))
        for i, c in enumerate(df.columns)
    ])
    counted = df.select(F.explode(F.array_compact(pairs)).alias("x")).select("x.*").distinct().groupBy("i").agg(F.count(F.lit(1)).alias("distinct_values"))
    names = df.sparkSession.createDataFrame(list(enumerate(df.columns)), "i int, column_name string")
    return names.join(counted, "i", "left").select("column_name", F.coalesce("distinct_values", F.lit(0)).cast("long").alias("distinct_values"))


def profile_cardinality(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct non-null values per column; ``approx`` shuffles fixed-size sketches instead of distinct values."""
    if not approx:
        return distinct_counts(df)
    counts = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in df.columns])
    return _unpivot(counts, df.columns, "long", "distinct_values").drop("_rows")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def _valid(df: DataFrame, c: str) -> Column:
    """The column in its own type, without NaN."""
    return number(c) if isinstance(df.schema[c].dataType, (FloatType, DoubleType)) else F.col(f"`{c}`")


def profile_numeric(df: DataFrame) -> DataFrame:
    """NaN counts as missing. Count, mean, sample deviation, minimum, quartiles and maximum per numeric column, 2 decimals.

    Three scans: the moments are computed beside the sketches of the quartiles.
    """
    columns = numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column_name string, " + ", ".join(f"`{s}` double" for s in NUMERIC_STATS))
    moments = [
        F.struct(F.count(number(c)).cast("double"), F.avg(_valid(df, c)).cast("double"), F.stddev_samp(number(c)), F.min(number(c)), F.max(number(c))).alias(f"m{i}")
        for i, c in enumerate(columns)
    ]
    quartiles, row = quantiles_and(df, columns, (0.25, 0.5, 0.75), moments)
    rows = df.sparkSession.createDataFrame([(c, *row[f"m{i}"]) for i, c in enumerate(columns)], "column_name string, count double, mean double, std double, min double, max double")
    quartiles = quartiles.groupBy("column_name").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(s) for p, s in ((0.25, "25%"), (0.5, "50%"), (0.75, "75%"))])
    # one row per column on either side
    joined = rows.join(F.broadcast(quartiles), "column_name", "left")
    return joined.select("column_name", *[np_round(F.col(f"`{s}`"), 2).alias(s) for s in NUMERIC_STATS])


def profile_lines(df: DataFrame, name: str, date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The whole profile of a table as ordered text lines ``(table_name, section, position, line)``."""
    order = F.create_map(*[x for i, c in enumerate(df.columns) for x in (F.lit(c), F.lit(i))])
    at = F.element_at(order, F.col("column_name"))

    def lines(section: int, part: DataFrame, position: Column, line: Column) -> DataFrame:
        return part.select(F.lit(name).alias("table_name"), F.lit(section).alias("section"),
                           position.cast("int").alias("position"), line.alias("line"))

    def heading(section: int, text: str) -> DataFrame:
        return df.sparkSession.createDataFrame([(name, section, -1, text)], "table_name string, section int, position int, line string")

    parts = [
        heading(0, f"PROFILING REPORT: {name}"),
        lines(0, profile_shape(df, name), F.lit(0), F.format_string(
            "Rows    : %,d\nColumns : %d\nNames   : [%s]", "row_count", "column_count", "column_names")),
        heading(1, "--- Missing Values ---"),
        lines(1, profile_missing(df), at, F.format_string(
            "  %-30s %5d missing  (%s%%)", "column_name", "missing", F.col("missing_pct").cast("string"))),
    ]
    nothing = null_counts(df).agg(F.sum("missing").alias("n")).where("n = 0 or n is null")
    parts.append(lines(1, nothing, F.lit(0), F.lit("  No missing values")))
    if "claim_id" in df.columns:
        parts += [heading(2, "--- Duplicate claim_ids ---"),
                  lines(2, profile_duplicates(df), F.lit(0), F.format_string("  %d duplicate(s) found", "duplicates"))]
    if date_columns(df):
        parts += [lines(3, profile_date_range(df, date_format), at, F.format_string(
            "--- Date Range (%s) ---\n  Min     : %s\n  Max     : %s\n  Invalid : %d unparseable date(s)", "column_name",
            F.coalesce(F.col("min_date").cast("string"), F.lit("NaT")),
            F.coalesce(F.col("max_date").cast("string"), F.lit("NaT")), "invalid"))]
    parts += [heading(4, "--- Column Cardinality (unique values) ---"),
              lines(4, profile_cardinality(df), at, F.format_string("  %-30s %5d unique", "column_name", "distinct_values"))]
    if numeric_columns(df):
        stats = F.concat_ws("  ", *[F.concat(F.lit(f"{s}="), F.coalesce(F.col(f"`{s}`").cast("string"), F.lit("NaN"))) for s in NUMERIC_STATS])
        parts += [heading(5, "--- Numeric Statistics ---"),
                  lines(5, profile_numeric(df), at, F.concat(F.format_string("  %-30s ", "column_name"), stats))]
    return reduce(DataFrame.unionByName, parts)


def profile_all(tables: Mapping[str, DataFrame], date_format: str = "yyyy-MM-dd") -> DataFrame:
    """The whole profile of every column of every table as one long table: rows, nulls, distinct values, repeated
    claim ids, dates and numeric statistics; what a column has not is null."""
    def part(item: tuple[str, DataFrame]) -> DataFrame:
        name, df = item
        dates = profile_date_range(df, date_format).select("column_name", *[F.col(c).cast("timestamp").alias(c) for c in ("min_date", "max_date")], F.col("invalid").cast("long").alias("invalid_dates"))
        part = null_counts(df).join(distinct_counts(df), "column_name").join(dates, "column_name", "left").join(profile_numeric(df), "column_name", "left")
        if "claim_id" in df.columns:
            repeats = profile_duplicates(df).select(F.lit("claim_id").alias("column_name"), "duplicates")
            part = part.join(repeats, "column_name", "left")
        else:
            part = part.withColumn("duplicates", F.lit(None).cast("long"))
        return part.withColumnRenamed("_rows", "row_count").withColumn("table_name", F.lit(name))

    # the scans of different tables are independent jobs
    with ThreadPoolExecutor(_AT_ONCE) as pool:
        parts = list(pool.map(part, tables.items()))
    return reduce(DataFrame.unionByName, parts).select(
        "table_name", "row_count", "column_name", "missing", "distinct_values", "duplicates", "min_date", "max_date", "invalid_dates", *NUMERIC_STATS)


def profile_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Profile text of all tables, one line per row in table order."""
    ordered = [
        profile_lines(df, name).withColumn("table_order", F.lit(i)) for i, (name, df) in enumerate(tables.items())
    ]
    return reduce(DataFrame.unionByName, ordered)


