"""Column expressions the native operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space that parts words: blank, tab, line feed, vertical tab, form feed, carriage return.
GAP = r"[\x20\x09-\x0D]+"


def text_of(column: str | Column = "text") -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def words_of(column: str | Column = "text") -> Column:
    """Words of a text, unchanged, in order; none for NULL or white space alone."""
    return F.filter(F.split(text_of(column), GAP), lambda w: w != "")


def plain_words_of(column: str | Column = "text") -> Column:
    """Words without case and punctuation: runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(text_of(column)), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def columns_or_null(df: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns, cast; a missing one is NULL, extra ones go."""
    have = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f"`{c}`") if c.lower() in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()
    ])
