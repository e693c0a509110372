"""Layer tables that grow batch by batch.

Rows are dealt by a hash of their key into a fixed number of buckets, one folder each. A batch reads and overwrites only the
buckets that its keys fall into; all other files stay as they are. A manifest lists the batches that are in the table, with
their place in the sequence and a digest of their rows: a batch that comes again changes nothing.

One writer at a time. A batch that broke off before it reached the manifest is applied again from the start, with the same
place, and leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors
from ..session import stage
from .tables import path_exists, read_layer

BUCKETS = 64
# Columns of the written table beside the layer's own.
BUCKET, SEQUENCE = "_bucket", "_batch"
_MANIFEST = "batch string, sequence int, rows long, digest string, key string, buckets int, keep string"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The batches in the table, with their place, rows and digest."""
    if not path_exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def _digest(df: DataFrame) -> tuple[int, str]:
    """Rows of a batch, and a sum of their hashes, which does not depend on their order."""
    names = sorted(df.columns)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.xxhash64(F.lit(k), *names).cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)]).first()
    return row["n"], f"{row['h0']}:{row['h1']}"


def _rank(key: str, keep: str) -> Column:
    order = F.asc(SEQUENCE) if keep == "first" else F.desc(SEQUENCE)
    # rows dealt by bucket lie right for this: a key has one bucket
    return F.row_number().over(Window.partitionBy(BUCKET, key).orderBy(order))


def upsert_layer(df: DataFrame, path: str, batch: str, key: str = "claim_id", keep: str = "first", buckets: int = BUCKETS) -> bool:
    """Merge a batch, one row per key, into the table under ``path``; returns whether it changed the table.

    ``keep`` says which row of a key stays, that of the ``first`` or of the ``last`` batch that has it; a null key is a key
    like any other. The same batch again, by name and rows, is left out; another batch of that name is an error, as are
    other settings or columns than the table's.
    """
    spark = df.sparkSession
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    names = [c for c in df.columns if c not in (BUCKET, SEQUENCE)]
    new = df.select(*names, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET))
    done = manifest(spark, path).collect()  # one row per batch
    # a batch that is in the table is only compared, so it is not written
    new = new if any(old["batch"] == batch for old in done) else stage(new, "upsert-batch")
    rows, digest = _digest(new)
    for old in done:
        if (old["key"], old["buckets"], old["keep"]) != (key, buckets, keep):
            raise errors.ClaimLensError(errors.SILVER_MISSING, f"table has key {old['key']}, {old['buckets']} buckets and keeps the {old['keep']}: {path}")
        if old["batch"] == batch:
            if old["digest"] != digest:
                raise errors.ClaimLensError(errors.SILVER_MISSING, f"another batch {batch} is in the table already: {path}")
            return False
    if new.groupBy(key).count().where("count > 1").isEmpty() is False:
        raise errors.ClaimLensError(errors.SILVER_MISSING, f"batch {batch} repeats a {key}")
    sequence = len(done)
    merged = new.withColumn(SEQUENCE, F.lit(sequence))
    if path_exists(spark, f"{path}/data"):
        touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]  # at most ``buckets``
        old = spark.read.parquet(f"{path}/data").where(F.col(BUCKET).isin(touched) & (F.col(SEQUENCE) != sequence))
        if sorted(old.columns) != sorted(merged.columns):
            raise errors.ClaimLensError(errors.SILVER_MISSING, f"batch {batch} has other columns than the table: {path}")
        # one shuffle serves the rank and the folders
        both = old.unionByName(merged).repartition(buckets, BUCKET)
        merged = both.withColumn("_rank", _rank(key, keep)).where("_rank = 1").drop("_rank")
        # written aside first: the buckets that are read are those that are overwritten
        dealt = stage(merged, "upsert-merged")
    else:
        dealt = merged.repartition(buckets, BUCKET)
    if rows:
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(f"{path}/data")
    entry = spark.createDataFrame([(batch, sequence, rows, digest, key, buckets, keep)], _MANIFEST)
    entry.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return True


def read_upserted(spark: SparkSession, path: str, code: str = errors.SILVER_MISSING) -> DataFrame:
    """The table without the columns of its upkeep."""
    return read_layer(spark, f"{path}/data", code=code).drop(BUCKET, SEQUENCE)
