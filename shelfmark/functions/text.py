"""Column functions for search text: sanitising and splitting into tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.fixed import QUERY_CHARACTERS, WHITESPACE

# \s under (?U) is Unicode White_Space; the four ASCII separators are added.
_SPACE = r"\s\x1c-\x1f"

# A token is a chain of letters, digits, marks and underscores. An apostrophe, full
# stop, colon or middle dot joins two letters; an apostrophe, full stop, comma or
# semicolon joins two digits. Possessive quantifiers keep the matcher iterative, so a
# very long token cannot exhaust the stack.
TOKEN = (
    r"(?:\p{L}++(?:['’.:·]\p{L}++)*+"
    r"|\p{N}++(?:['.,;]\p{N}++)*+"
    r"|[\p{M}_]++)++"
)


def sanitize_query(raw: Column | str, unicode: bool = False) -> Column:
    """Search text reduced to letters, digits, spaces and , - . % ' ( ).

    Other characters become spaces, hyphens at either end or standing alone are
    dropped, runs of whitespace become one space. Letters outside ASCII are dropped
    unless ``unicode``, although the catalogue keeps them.
    """
    text = F.btrim(F.coalesce(_col(raw), F.lit("")), F.lit(WHITESPACE))
    kept = QUERY_CHARACTERS + (r"\p{L}\p{M}\p{N}" if unicode else "")
    text = F.regexp_replace(text, f"(?U)[^{_SPACE}{kept}]", " ")
    text = F.regexp_replace(text, f"(?U)[{_SPACE}]-[{_SPACE}]|^-|-$", " ")
    return F.btrim(F.regexp_replace(text, f"(?U)[{_SPACE}]+", " "))


def tokens(text: Column | str, pattern: str = TOKEN) -> Column:
    """Lower-case tokens of ``text`` in order; an empty array for null."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(text), F.lit(""))), F.lit(pattern), F.lit(0))


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value
