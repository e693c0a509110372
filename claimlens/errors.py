"""One error type: a searchable code, whose first letters name the layer, next to the message."""

# Codes shared with existing log searches.
FILE_NOT_FOUND = "ING-1001"
SCHEMA_MISMATCH = "ING-1002"
BRONZE_MISSING = "ING-1004"
HIGH_NULL_RATE = "SLV-2001"
JOIN_NULLS = "SLV-2004"
SILVER_MISSING = "GLD-3001"
FEATURE_ALL_NULL = "GLD-3002"
LABEL_IMBALANCE = "GLD-3003"
MODEL_NOT_FOUND = "ML-4001"
INSUFFICIENT_DATA = "ML-4005"
NO_DOCUMENTS = "RAG-5001"
INDEX_NOT_FOUND = "RAG-5002"

_LAYERS = {"ING": "ingestion", "SLV": "silver", "GLD": "features", "ML": "model", "RAG": "retrieval"}


class ClaimLensError(Exception):
    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"[{code}] {message}")
        self.error_code, self.message = code, message

    @property
    def layer(self) -> str:
        return _LAYERS[self.error_code.partition("-")[0]]
