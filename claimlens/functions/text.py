"""Column expressions over text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import CHUNK_OVERLAP, CHUNK_WORDS, WHITESPACE, WHITESPACE_CLASS


def normal_name(header: str) -> str:
    """Column name of a file header: stripped, lower case, blanks as underscores."""
    return header.strip().lower().replace(" ", "_")


def strip(col: Column | str) -> Column:
    """Remove Unicode whitespace from both ends (SQL ``trim`` knows only the blank).

    Trimming by a list of characters costs several times what looking at both ends does, and most text has nothing to trim:
    one that starts and ends with a visible ASCII character is taken as it is.
    """
    text = F.col(col) if isinstance(col, str) else col
    clean = F.left(text, F.lit(1)).between("!", "~") & F.right(text, F.lit(1)).between("!", "~")
    return F.when(clean, text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def code(col: Column | str) -> Column:
    """Normal form of a medical code: stripped, upper case."""
    return F.upper(strip(col))


def words(col: Column | str) -> Column:
    """Whitespace-separated words, without the empty strings a split leaves at the ends."""
    return F.filter(F.split(col, WHITESPACE_CLASS + "+"), lambda w: w != "")


def word_windows(words_col: Column, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of overlapping word windows; the last may be short, no words give an empty array.

    Windows start every ``size - overlap`` words (at least one) and end with the first window that
    reaches the last word, so window i exists when i = 0 or window i-1 stopped short of the end.
    """
    step = max(size - overlap, 1)

    def windows(w: Column) -> Column:
        last = F.greatest(F.lit(0), F.ceil((F.size(w) - size) / step)).cast("int")
        cut = F.transform(
            F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(w, i * step + 1, size), " ")
        )
        return F.when(F.size(w) > 0, cut).otherwise(F.array().cast("array<string>"))

    # A one-element transform binds the words to a name: split once, not once per window.
    return F.transform(F.array(words_col), windows)[0]
