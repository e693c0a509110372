"""Text files that hold many documents, cut at marks into splits: one large file is read by many tasks.

The mark ends a record for Spark's text reader, which cuts files anywhere, lets each task begin behind the first mark of its
split and read on to the mark that ends its last record. So no task sees a whole file, and no document is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import errors
from ..session import stage
from .tables import path_exists

MARK = "\n--- end of document ---\n"


def read_marked_docs(spark: SparkSession, directory: str, mark: str = MARK, pattern: str = "*.txt") -> DataFrame:
    """(source_file, document, text): every document of the files of a folder, numbered from 0 in its file.

    What stands before the first mark is a document, and so is what stands behind the last, if there is any text. Documents
    without text count, but are left out. Compressed files cannot be cut and take one task each.
    """
    if not path_exists(spark, directory):
        raise errors.ClaimLensError(errors.NO_DOCUMENTS, f"policy directory not found: {directory}")
    raw = spark.read.option("pathGlobFilter", pattern).option("lineSep", mark).text(directory)
    rows = stage(raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("place"), "value"), "marked-docs")
    # a split's records are numbered by its task; the records of earlier splits come first: one row per split
    splits = rows.groupBy("path", "split").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.join(splits.withColumn("before", before).drop("n"), ["path", "split"])
    name = F.element_at(F.split("path", "/"), -1)
    return numbered.where("value <> ''").select(name.alias("source_file"), (F.col("before") + F.col("place") - F.col("first")).alias("document"), F.col("value").alias("text"))


def write_marked_docs(texts: DataFrame, path: str, column: str = "text", mark: str = MARK, files: int | None = None) -> str:
    """Write texts as files of documents that end with the mark; a text must not contain it."""
    rows = texts.select(F.when(F.contains(column, F.lit(mark)), F.raise_error(F.lit("a text contains the mark"))).otherwise(F.col(column)).alias("value"))
    (rows.coalesce(files) if files else rows).write.mode("overwrite").option("lineSep", mark).option("compression", "none").text(path)
    return path
