"""Claim tables derived from an order-line star schema.

Every order line is a claim. The raw table is dirty on purpose: repeated claim ids, padded and
lower-case codes, missing fields and unreadable dates, each by a rule over the line's keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.numbers import np_round
from ..operators.clean import POSITION
from ..operators.serving import risk_level


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Raw claim fields as expressions over lineitem.
RAW_FIELDS = {
    "claim_id": "concat('C', l_orderkey, '-', l_linenumber)",
    "provider_id": "CASE WHEN l_partkey % 9 = 0 THEN concat('  PR', l_suppkey, chr(9)) ELSE concat('PR', l_suppkey) END",
    "diagnosis_code": (
        "CASE WHEN (l_orderkey * 7 + l_linenumber) % 10 < 3 THEN NULL"
        " WHEN l_partkey % 4 = 1 THEN concat('d', 10 * (1 + l_partkey % 7))"
        " WHEN l_partkey % 5 = 2 THEN concat(' D', 10 * (1 + l_partkey % 7), chr(160))"
        " ELSE concat('D', 10 * (1 + l_partkey % 7)) END"
    ),
    "procedure_code": (
        "CASE WHEN (l_orderkey + l_linenumber * 3) % 4 = 0 THEN NULL"
        " WHEN l_partkey % 3 = 2 THEN concat(chr(9), 'proc', 1 + l_partkey % 6)"
        " ELSE concat('PROC', 1 + l_partkey % 6) END"
    ),
    "billed_amount": "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_extendedprice END",
    "date": (
        "CASE WHEN l_partkey % 50 = 7 THEN 'unknown' WHEN l_partkey % 50 = 8 THEN '2000-02-30'"
        " ELSE date_format(l_shipdate, 'yyyy-MM-dd') END"
    ),
}


def with_position(df: DataFrame) -> DataFrame:
    """Adds the place of each row of a table of files as one whole number: the number of its file in order of the paths, and the
    row's in the file. A row of a shuffle carries eight bytes instead of a path."""
    files = sorted(df.inputFiles())
    if len(files) < 2:
        return df.withColumn(POSITION, F.col("_metadata.row_index"))
    numbers = df.sparkSession.createDataFrame(list(enumerate(files)), "_number long, _path string")
    # one row per file; Spark broadcasts them if their size allows
    placed = df.withColumn("_path", F.input_file_name()).withColumn("_row", F.col("_metadata.row_index")).join(numbers, "_path", "left")
    known = F.when(F.col("_number").isNull(), F.raise_error(F.lit("a file without a number"))).otherwise(F.col("_number"))
    return placed.withColumn(POSITION, F.shiftleft(known, 40) + F.col("_row")).drop("_path", "_row", "_number")


def lines_to_claims(lines: DataFrame) -> DataFrame:
    """Raw claims without patient, straight from the order lines."""
    return lines.selectExpr(*[f"{expr} AS {name}" for name, expr in RAW_FIELDS.items()])


def raw_claims(spark: SparkSession, sf_dir: str, patient: bool = False, position: bool = False) -> DataFrame:
    """Raw claims; the patient comes from the order and costs a join, so it is added on request.

    ``position`` adds the place of the row in its file, by which the first of several rows is told. A line without an
    order has no patient.
    """
    lines = table(spark, sf_dir, "lineitem")
    fields = dict(RAW_FIELDS)
    if position:
        lines = with_position(lines)
        fields[POSITION] = POSITION
    if not patient:
        return lines.selectExpr(*[f"{expr} AS {name}" for name, expr in fields.items()])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fields = {"claim_id": RAW_FIELDS["claim_id"], "patient_id": "concat('P', o_custkey)"} | fields
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.selectExpr(*[f"{expr} AS {name}" for name, expr in fields.items()])


def raw_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the nation table is a fixed list of 25 rows
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    joined = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return joined.selectExpr(
        "concat('PR', s_suppkey) AS provider_id",
        "concat(' ', s_name, ' ') AS doctor_name",
        "CASE s_nationkey % 4 WHEN 0 THEN 'Cardiology' WHEN 1 THEN 'Neurology' WHEN 2 THEN 'Orthopedics' ELSE 'General' END AS specialty",
        "CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE n_name END AS location",
    )


def diagnosis(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.DIAGNOSIS_ROWS), "diagnosis_code string, category string, severity string")


def cost(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(K.COST_ROWS), "procedure_code string, average_cost double, expected_cost double")


def raw_part_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diagnosis reference as large as the part table."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat(' d', p_partkey, chr(9)) AS ` Diagnosis Code`",
        "concat(p_type, '  ') AS Category",
        "CASE WHEN p_size > 25 THEN ' High' ELSE 'Low ' END AS severity",
    )


def raw_part_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cost reference as large as the part table, with costs as text and some unreadable ones."""
    return table(spark, sf_dir, "part").selectExpr(
        "concat(' proc', p_partkey) AS procedure_code",
        "CASE WHEN p_partkey % 7 = 0 THEN 'n/a' ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) END AS average_cost",
        "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) END AS expected_cost",
    )


def bronze(spark: SparkSession, sf_dir: str, patient: bool = False, position: bool = False) -> dict[str, DataFrame]:
    return {
        "bronze_claims": raw_claims(spark, sf_dir, patient, position),
        "bronze_providers": raw_providers(spark, sf_dir),
        "bronze_diagnosis": diagnosis(spark),
        "bronze_cost": cost(spark),
    }


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction history from the event stream: one scored claim per event."""
    p = np_round(F.col("value") / 500.0, 4)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("user"), "user_id").alias("username"),
        F.concat(F.lit("C"), "event_id").alias("claim_id"),
        F.concat(F.lit("P"), "user_id").alias("patient_id"),
        F.concat(F.lit("PR"), F.col("event_id") % 100).alias("provider_id"),
        (F.col("value") * 100).alias("billed_amount"),
        F.lit(None).cast("string").alias("diagnosis_code"),
        F.lit("PROC1").alias("procedure_code"),
        p.alias("denial_probability"),
        risk_level(p).alias("risk_level"),
        (p >= 0.37).cast("int").alias("is_denied"),
        F.col("event_type").alias("flags"),
        F.col("ts").alias("submitted_at"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as policy files."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc"), "doc_id", F.lit(".txt")).alias("source_file"), "text"
    )

