"""Column functions that turn raw text into typed values, null where the text is not valid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.fixed import WHITESPACE

# try_cast alone is too generous: it takes '1.5d' for a number and '2024' for a date.
FLOAT_TEXT = r"(?i)^[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)$|^nan$"
DATE_TEXT = r"^(?!0000)\d{4}-\d{2}-\d{2}$"
INT_TEXT = r"^[+-]?\d+$"


def clean_text(raw: Column | str) -> Column:
    """Text without surrounding whitespace (any Unicode kind); null becomes ''."""
    return F.btrim(F.coalesce(_col(raw), F.lit("")), F.lit(WHITESPACE))


def blank_to_null(raw: Column | str) -> Column:
    return F.nullif(clean_text(raw), F.lit(""))


def safe_int(raw: Column | str) -> Column:
    """BIGINT, or null for anything that is not an optionally signed row of digits."""
    text = clean_text(raw)
    return F.when(text.rlike(INT_TEXT), text.try_cast("bigint"))


def safe_double(raw: Column | str, finite_only: bool = False) -> Column:
    """DOUBLE, or null. Exponents, infinities and nan are valid unless ``finite_only``."""
    text = clean_text(raw)
    value = F.when(text.rlike(FLOAT_TEXT), text.try_cast("double"))
    if finite_only:
        value = F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)
    return value


def safe_date(raw: Column | str) -> Column:
    """DATE from YYYY-MM-DD only, or null."""
    text = clean_text(raw)
    return F.when(text.rlike(DATE_TEXT), text.try_cast("date"))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
