"""Normalisation of identifiers and numeric text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space removed around a value.
BLANKS = " \t\n\r\f\x0b"

#: Texts a CSV reader of the data frame kind takes for NULL.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: A number as Python's float accepts it, without Java's d and f suffixes.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def trimmed(c: Column | str) -> Column:
    """Without surrounding white space (tabs and line ends too, which trim() keeps)."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS))


def normalised(c: Column | str) -> Column:
    """Trimmed and lower-cased: the form in which sids, hashes and addresses compare."""
    return F.lower(trimmed(c))


def null_tokens_to_null(c: Column | str) -> Column:
    """NULL for the null tokens; every other text as it is."""
    col = F.col(c) if isinstance(c, str) else c
    return F.when(~col.isin(*NULL_TOKENS), col)


def number_or_null(c: Column | str) -> Column:
    """Text to double; NULL where the text isn't a plain decimal number."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), t.try_cast("double"))


def whole_number_text(c: Column | str) -> Column:
    """A digit string without leading zeros ("007" and " 7" give "7"); other texts normalised as they are."""
    t = normalised(c)
    return F.when(t.rlike(r"^[0-9]+$"), F.regexp_replace(t, r"^0+(?=[0-9])", "")).otherwise(t)


def spread_nulls(key: str, by: str) -> Column:
    """A text key for an outer join: as it is, or a text that matches none where it is NULL, spread by another column so that such rows don't gather in one task."""
    return F.coalesce(F.col(key), F.concat(F.lit("\x00null "), F.pmod(F.xxhash64(by), F.lit(4096)).cast("string")))
