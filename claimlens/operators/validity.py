"""Reference tables with dates: a claim gets the row that was valid on its day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stage


def valid_on(
    claims: DataFrame, reference: DataFrame, key: str, columns: Sequence[str], day: str = "claim_date", valid_from: str = "valid_from", valid_to: str | None = None,
) -> DataFrame:
    """Adds ``columns`` of the latest ``reference`` row of the same key whose ``valid_from`` is not after the claim's day.

    With ``valid_to`` a row ends before that day, and nothing valid is found in the gap behind it; null is no end. Of
    several rows of a key with one ``valid_from`` the last by the values of ``columns`` counts. Claims without key or day, or
    before the first row, get nulls.

    Reference rows and claims are sorted together by key and day in ranges of even size, so a key with most of the claims is
    cut into as many ranges as it needs. Inside a range the latest reference row is carried along; what a range inherits comes
    from the last rows of the ranges before it, one row per range and key.
    """
    taken = [c for c in columns if c in claims.columns]
    if taken:
        raise ValueError(f"claims have {taken} already")
    struct = F.struct(*[F.col(c) for c in columns], (F.col(valid_to).cast("date") if valid_to else F.lit(None).cast("date")).alias("_to"))
    rows = reference.where(F.col(key).isNotNull() & F.col(valid_from).isNotNull())
    rows = rows.select(F.col(key).alias("_key"), F.to_date(valid_from).alias("_day"), struct.alias("_ref")).groupBy("_key", "_day").agg(F.max("_ref").alias("_ref"))
    asked = claims.select(F.struct(*[F.col(f"`{c}`") for c in claims.columns]).alias("_row"), F.col(key).alias("_key"), F.to_date(day).alias("_day"))
    plain = asked.where("_key is null or _day is null")
    both = asked.where("_key is not null and _day is not null").select("_row", "_key", "_day", F.lit(None).cast(rows.schema["_ref"].dataType).alias("_ref"), F.lit(1).alias("_kind")).unionByName(
        rows.select(F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), "_key", "_day", "_ref", F.lit(0).alias("_kind")))
    # claims of one key and day are told apart by a hash, so that even these can lie in several ranges
    tie = F.xxhash64("_row")
    ranged = both.withColumn("_tie", tie).repartitionByRange("_key", "_day", "_kind", "_tie").withColumn("_part", F.spark_partition_id())
    ranged = stage(ranged, "valid-ranges")
    along = Window.partitionBy("_part", "_key").orderBy("_day", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumn("_own", F.last("_ref", ignorenulls=True).over(along))
    # the last reference row of each range and key; a key lies in neighbouring ranges only
    ends = ranged.groupBy("_part", "_key").agg(F.max_by("_ref", F.when(F.col("_kind") == 0, F.col("_day"))).alias("_end"))
    earlier = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("_part", "_key", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")).where("_carried is not null")
    found = own.where("_kind = 1").join(carried, ["_part", "_key"], "left").withColumn("_found", F.coalesce("_own", "_carried"))
    open_ = F.col("_found._to").isNull() | (F.col("_day") < F.col("_found._to"))
    matched = found.select("_row", F.when(open_, F.col("_found")).alias("_found"))
    whole = matched.unionByName(plain.select("_row", F.lit(None).cast(rows.schema["_ref"].dataType).alias("_found")))
    return whole.select("_row.*", *[F.col(f"_found.`{c}`").alias(c) for c in columns])
