"""Explicit schemas of every persisted table, so no layer depends on inference."""

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)


def _struct(*fields) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


_S, _D, _I, _L, _T = StringType(), DoubleType(), IntegerType(), LongType(), TimestampType()

RAW_CLAIMS = _struct(
    ("claim_id", _S), ("patient_id", _S), ("provider_id", _S), ("diagnosis_code", _S),
    ("procedure_code", _S), ("billed_amount", _D), ("date", _S),
)
RAW_PROVIDERS = _struct(
    ("provider_id", _S), ("doctor_name", _S), ("specialty", _S), ("location", _S)
)
RAW_DIAGNOSIS = _struct(("diagnosis_code", _S), ("category", _S), ("severity", _S))
# Costs stay text until clean_cost coerces them: a stray word must become null, not fail the read.
RAW_COST = _struct(
    ("procedure_code", _S), ("average_cost", _S), ("expected_cost", _S), ("region", _S)
)

RAW_SCHEMAS = {
    "bronze_claims": RAW_CLAIMS,
    "bronze_providers": RAW_PROVIDERS,
    "bronze_diagnosis": RAW_DIAGNOSIS,
    "bronze_cost": RAW_COST,
}

CHUNK_METADATA = _struct(("source_file", _S), ("chunk_index", _I), ("total_chunks", _I))
POLICY_CHUNK = StructType([
    StructField("chunk_id", _S), StructField("source_file", _S), StructField("text", _S),
    StructField("metadata", CHUNK_METADATA),
])
POLICY_INDEX = StructType([
    *POLICY_CHUNK.fields, StructField("embedding", ArrayType(FloatType())),
])

HISTORY = _struct(
    ("id", _L), ("username", _S), ("claim_id", _S), ("patient_id", _S), ("provider_id", _S),
    ("billed_amount", _D), ("diagnosis_code", _S), ("procedure_code", _S),
    ("denial_probability", _D), ("risk_level", _S), ("is_denied", _I), ("flags", _S),
    ("submitted_at", _T),
)
