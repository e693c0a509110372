"""CSV with a quarantine: every line becomes a row of the table or a row of the rejected ones, none is lost.

A line is rejected if it has more or fewer fields than the header, or a field that does not fit its declared type.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import errors
from ..functions.text import normal_name
from ..session import scratch_path
from .tables import _CSV, path_exists, stamp

_CORRUPT = "_corrupt_record"


def read_with_quarantine(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Good rows like ``ingest_csv`` gives them, and rejected ones ``(source_file, line, n_fields, expected_fields)``.

    Both come from one parse, which is written once. Columns keep the file's names and order; a column of ``schema`` gets its
    type, any other stays text. An empty line is no line. Lines end at line breaks: a quoted field cannot hold one here.
    """
    if not path_exists(spark, path):
        raise errors.ClaimLensError(errors.FILE_NOT_FOUND, f"cannot read CSV file: {path}")
    try:
        header = spark.read.options(**_CSV).csv(path).columns
    except AnalysisException as exc:
        raise errors.ClaimLensError(errors.FILE_NOT_FOUND, f"cannot read CSV file: {path}") from exc
    types = {f.name: f.dataType for f in schema.fields}
    fields = [StructField(c, types.get(normal_name(c), StringType())) for c in header]
    reader = spark.read.options(**_CSV).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT).option("enforceSchema", "true")
    # a further text column shows lines with more fields than the header, which the parser would cut silently
    parsed = reader.schema(StructType([*fields, StructField(_CORRUPT, StringType())])).csv(path)
    kept = scratch_path(spark, "quarantine")
    parsed.select("*", F.input_file_name().alias("_file")).write.parquet(kept)
    rows = spark.read.parquet(kept)
    name = path.rstrip("/").rsplit("/", 1)[-1]
    good = stamp(rows.where(F.col(_CORRUPT).isNull()).drop(_CORRUPT, "_file"), name)
    # the fields of a rejected line, read as text
    n = F.size(F.regexp_extract_all(F.col(_CORRUPT), F.lit(r'(?:^|,)(?:"(?:[^"]|"")*"|[^,]*)'), F.lit(0)))
    bad = rows.where(F.col(_CORRUPT).isNotNull()).select(F.lit(name).alias("source_file"), F.col(_CORRUPT).alias("line"), n.alias("n_fields"), F.lit(len(header)).alias("expected_fields"))
    return good, bad


def ingest_with_quarantine(spark: SparkSession, path: str, schema: StructType, base: str, table: str) -> tuple[int, int]:
    """Write the good rows to a Bronze table and the rejected ones beside it; returns the rows of both."""
    good, bad = read_with_quarantine(spark, path, schema)
    good.write.mode("overwrite").parquet(f"{base}/{table}")
    bad.write.mode("overwrite").parquet(f"{base}/{table}_rejected")
    return tuple(spark.read.parquet(f"{base}/{t}").count() for t in (table, f"{table}_rejected"))
