"""Layer tables: Parquet between layers, CSV at the edges."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import errors
from ..constants import RAW_FILES
from ..functions.text import normal_name
from ..schemas import HISTORY, RAW_SCHEMAS

# Text is written and read as it is: no trimming, empty field = null.
_CSV = {"header": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "escape": '"'}


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def ingest_csv(spark: SparkSession, path: str, schema: StructType, multiline: bool = False) -> DataFrame | None:
    """Raw CSV with its two metadata columns; None when the file is missing.

    Columns keep the file's names and order; a column of ``schema`` gets its type, any other stays
    text. Only a header line is read for that, and files split freely. All files of a folder need the same header: one
    with other names or another order ends the read with an error. Files with line breaks inside fields need
    ``multiline``, which reads a file in one task.
    """
    if not path_exists(spark, path):
        return None
    reader = spark.read.options(**_CSV).option("multiLine", multiline)
    try:
        header = reader.csv(path).columns
    except AnalysisException as exc:
        raise errors.ClaimLensError(errors.FILE_NOT_FOUND, f"cannot read CSV file: {path}") from exc
    types = {f.name: f.dataType for f in schema.fields}
    found = StructType([StructField(c, types.get(normal_name(c), StringType())) for c in header])
    raw = reader.schema(found).option("enforceSchema", "false").csv(path)
    return stamp(raw, path.rstrip("/").rsplit("/", 1)[-1])


def stamp(df: DataFrame, source_file: str) -> DataFrame:
    return df.withColumns({"ingestion_timestamp": F.current_timestamp(), "source_file": F.lit(source_file)})


def write_layer(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> str:
    """Overwrite a layer table, as Parquet or in any other format the session has (ORC, Delta, ...)."""
    writer = df.write.mode("overwrite").format(fmt)
    (writer.partitionBy(partition_by) if partition_by else writer).save(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").options(**_CSV).csv(path)
    return path


def save_bronze(df: DataFrame, base: str, table: str, fmt: str = "parquet") -> str:
    path = f"{base}/{table}"
    return write_csv(df, path) if fmt == "csv" else write_layer(df, path, fmt=fmt)


def read_layer(
    spark: SparkSession, path: str, schema: StructType | None = None,
    code: str = errors.BRONZE_MISSING,
) -> DataFrame:
    """Read a Parquet layer; a missing table raises the layer's error."""
    try:
        reader = spark.read.schema(schema) if schema else spark.read
        return reader.parquet(path)
    except AnalysisException as exc:
        raise errors.ClaimLensError(code, f"table not found: {path}") from exc


def load_bronze(spark: SparkSession, base: str, table: str) -> DataFrame:
    return read_layer(spark, f"{base}/{table}")


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    return read_layer(spark, path, code=errors.SILVER_MISSING)


def ingest_csv_table(spark: SparkSession, path: str, schema: StructType, base: str, table: str) -> int:
    """Ingest one CSV into a Bronze table and return the rows written; a missing file is an error."""
    df = ingest_csv(spark, path, schema)
    if df is None:
        raise FileNotFoundError(f"source file not found: {path}")
    written = save_bronze(df, base, table)
    return spark.read.parquet(written).count()


def ingest_all(
    spark: SparkSession, raw_dir: str, base: str,
    files: Mapping[str, str] = RAW_FILES, schemas: Mapping[str, StructType] = RAW_SCHEMAS,
) -> DataFrame:
    """Ingest every configured file; one report row per table, missing files reported with 0 rows."""
    report = []
    for file_name, table in files.items():
        try:
            rows = ingest_csv_table(spark, f"{raw_dir}/{file_name}", schemas[table], base, table)
            report.append((table, "LOADED", rows))
        except FileNotFoundError:
            report.append((table, "MISSING", 0))
    return spark.createDataFrame(report, "table_name string, status string, row_count long")


def read_claims_batch(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """An uploaded claims CSV, all rows of it."""
    df = ingest_csv(spark, path, schema)
    if df is None:
        raise errors.ClaimLensError(errors.FILE_NOT_FOUND, f"claims file not found: {path}")
    return df.drop("ingestion_timestamp", "source_file")


def write_history(rows: DataFrame, path: str, run: str, batch_id: int = 0) -> None:
    """Write one batch of the prediction history to its own partition; writing it again replaces it.

    Every row gets an ``id`` that no other row of the history has. It is not a counter: ``submitted_at`` tells the order.
    """
    row = F.xxhash64(F.lit(run), F.lit(batch_id), "claim_id", "username", F.monotonically_increasing_id())
    rows.withColumn("id", row).select(*[c for c in HISTORY.names if c in (*rows.columns, "id")]).write.mode("overwrite").parquet(
        f"{path}/run={run}/batch_id={batch_id}")


def append_history(rows: DataFrame, path: str) -> str:
    """Add a scored batch to the prediction history as a run of its own; returns the run's name."""
    run = f"batch-{uuid.uuid4().hex}"
    write_history(rows, path, run)
    return run


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs, of batches and streams."""
    return read_layer(spark, path, HISTORY).select(*HISTORY.names)


def write_report(lines: DataFrame, path: str, order: tuple[str, ...] = ("position",)) -> str:
    """Write report lines in order as text; reports have a few lines per column, so one file holds them."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)
    return path
