"""Small tables for the operators; the session comes from the parent folder."""

import pytest

LANGS = ("en", "de")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows, extra=False):
        """Documents of (doc_id, text[, source]); ``extra`` adds columns with names that the operators use inside."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
        if extra:
            for name in ("row", "part", "before", "size", "key", "tie", "target", "fp", "h", "words", "block", "start", "ids", "n_tokens"):
                df = df.selectExpr("*", f"'x' as {name}")
        return df

    return make
