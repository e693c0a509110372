"""Sums of all earlier rows over a whole table, without a task that sees all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlens.llm.common import stage


def _running(group: str, value: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False)
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            total = np.cumsum(v)
            before = total - v
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
            lengths = np.diff(np.r_[starts, len(g)])
            before -= np.repeat(before[starts], lengths)
            if last is not None and g[0] == last:
                before[: lengths[0]] += carried
            last, carried = g[-1], int(before[-1] + v[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], names=[*batch.schema.names, "before"])

    return run


def prefix_sums(df: DataFrame, group: str, order: list[Column], value: str, name: str) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the earlier rows of the same ``group`` (an integer without nulls).

    Rows are dealt out by ranges of (group, order), so a group of any size is cut into as many ranges as it needs.
    Each range sums its own rows; the totals of ranges, one row for each range and group, are summed by a window,
    and added back. The rows are written once between the two steps: the ranges then stay as they are.
    Rows equal in ``order`` keep any order among themselves. An empty table stays empty.
    """
    keys = [F.col(group).asc(), *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    schema = T.StructType([*ranged.schema.fields, T.StructField("before", T.LongType())])
    rows = stage(ranged.mapInArrow(_running(group, value), schema), name)
    totals = rows.groupBy(group, "part").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(group, "part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    return (
        rows.join(bases, [group, "part"])
        .withColumn("before", F.col("before") + F.col("base"))
        .drop("base", "part")
    )
