"""Profiles that merge: one small row per column and partition, with sketches instead of values.

A new partition is scanned once, for itself alone; the profile of the whole table is made from the rows. Counts, sums and
extremes are exact, distinct values and quantiles estimates: the error of a distinct count is one percent on the average (HLL of
DISTINCT_BITS), that of a quantile's rank some thousandth (KLL of QUANTILE_ITEMS), however many partitions are merged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors
from ..sources.tables import read_layer
from .profile import numeric_columns
from .quantiles import number

DISTINCT_BITS = 14
QUANTILE_ITEMS = 2000
QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def partition_profile(df: DataFrame) -> DataFrame:
    """A row per column: rows, missing, distinct sketch; for numbers count, mean, squares around it, extremes and quantile sketch.

    One scan, one aggregate. NaN counts as a missing number, but not as a null. Distinct values are told by a hash of 64 bits.
    """
    numeric = set(numeric_columns(df))

    def summary(c: str) -> Column:
        x = number(c) if c in numeric else F.lit(None).cast("double")
        n = F.count(x)
        return F.struct(
            F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col(f"`{c}`").isNull()).alias("missing"),
            F.hll_sketch_agg(_value(c), DISTINCT_BITS).alias("distinct"),
            n.alias("n"), F.avg(x).alias("mean"), (F.var_pop(x) * n).alias("squares"), F.min(x).alias("min"), F.max(x).alias("max"),
            F.kll_sketch_agg_double(x, QUANTILE_ITEMS).alias("quantiles"),
        ).alias(f"c{df.columns.index(c)}")

    one = df.agg(*[summary(c) for c in df.columns])
    return one.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])))


def _value(c: str) -> Column:
    """The hash of a value; null, which a sketch leaves out, for a null."""
    return F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.col(f"`{c}`")))


def write_partition_profile(df: DataFrame, path: str, partition: str) -> str:
    """The profile of one partition; writing it again replaces it."""
    partition_profile(df).coalesce(1).write.mode("overwrite").parquet(f"{path}/partition={partition}")
    return path


def merged_profile(spark: SparkSession, path: str) -> DataFrame:
    """Rows, missing, distinct estimate, mean, sample deviation, extremes and quartile estimates of every column of all partitions."""
    parts = read_layer(spark, path, code=errors.BRONZE_MISSING)
    whole = Window.partitionBy("column_name")
    # a row per column and partition: means first, then squares around the common mean
    middle = F.sum(F.col("n") * F.col("mean")).over(whole) / F.nullif(F.sum("n").over(whole), F.lit(0))
    around = F.col("squares") + F.col("n") * (F.col("mean") - F.col("middle")) * (F.col("mean") - F.col("middle"))
    merged = parts.withColumn("middle", middle).groupBy("column_name").agg(
        F.sum("rows").alias("rows"), F.sum("missing").alias("missing"), F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_estimate"),
        F.sum("n").alias("n"), F.max("middle").alias("mean"), F.sum(around).alias("squares"), F.min("min").alias("min"), F.max("max").alias("max"),
        F.kll_merge_agg_double("quantiles").alias("quantiles"))
    there = F.col("n") > 0
    quartiles = {name: F.when(there, F.kll_sketch_get_quantile_double("quantiles", F.lit(p))) for name, p in QUARTILES.items()}
    return merged.select("column_name", "rows", "missing", "distinct_estimate", "mean", F.when(F.col("n") > 1, F.sqrt(F.col("squares") / (F.col("n") - 1))).alias("std"),
                         "min", "max", *[x.alias(name) for name, x in quartiles.items()])


def rank_span(df: DataFrame, quantiles: DataFrame) -> DataFrame:
    """(column_name, name, below, upto): the shares of a column's values that lie below its estimated quartiles, and up to them."""
    asked = {r["column_name"]: r for r in quantiles.collect()}  # a row per column
    tests = [(c, name, asked[c][name]) for c in numeric_columns(df) for name in QUARTILES if c in asked and asked[c][name] is not None]
    if not tests:
        return df.sparkSession.createDataFrame([], "column_name string, name string, below double, upto double")
    one = df.agg(*[F.struct(F.lit(c).alias("column_name"), F.lit(name).alias("name"), (F.count_if(number(c) < q) / F.count(number(c))).alias("below"),
                            (F.count_if(number(c) <= q) / F.count(number(c))).alias("upto")).alias(f"t{i}") for i, (c, name, q) in enumerate(tests)])
    return one.select(F.inline(F.array(*[F.col(f"t{i}") for i in range(len(tests))])))
