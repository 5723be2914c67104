"""Text cleaning and parsing as Column expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetlens.config import SERIAL_PATTERN

_SPACE = " \t\n\r\f\u000b "


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Text without surrounding white space; NULL stays NULL."""
    return F.trim(col(c), F.lit(_SPACE))


def clean(c: Column | str) -> Column:
    """Trimmed text, NULL as the empty string."""
    return F.coalesce(trimmed(c), F.lit(""))


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(trimmed(c), F.lit(""))


def label(c: Column | str, default: str) -> Column:
    """Trimmed text, or ``default`` where it is blank or NULL."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def is_any(c: Column | str, values: Iterable[str]) -> Column:
    """Cleaned text is one of ``values``."""
    return clean(c).isin(list(values))


def contains_text(columns: Iterable[Column | str], query: str, min_length: int = 2) -> Column | None:
    """Case-insensitive literal substring over several columns; None if the query is too short."""
    q = query.lower()
    if len(q) < max(1, min_length):
        return None
    found = None
    for c in columns:
        hit = F.coalesce(F.lower(col(c).cast("string")), F.lit("")).contains(q)
        found = hit if found is None else found | hit
    return found


def serial_of(c: Column | str) -> Column:
    """First device serial inside a text, upper case; NULL if there is none."""
    return F.nullif(F.regexp_extract(F.upper(col(c)), SERIAL_PATTERN, 1), F.lit(""))


def model_of(c: Column | str) -> Column:
    """Model token: three or more leading letters, else two characters before a dash, else ''."""
    text = clean(c)
    word = F.nullif(F.regexp_extract(text, "^([A-Za-z]{3,})", 1), F.lit(""))
    code = F.regexp_extract(text, "^([A-Za-z0-9]{2})-", 1)
    return F.upper(F.coalesce(word, code))


def digits_only(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^0-9]", "")


def whole_number(c: Column | str) -> Column:
    """Text as BIGINT, NULL where it is no whole number."""
    return col(c).try_cast("bigint")


def decimal_number(c: Column | str) -> Column:
    """Text as DOUBLE, NULL where it is no number."""
    return col(c).try_cast("double")
