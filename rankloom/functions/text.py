"""Text expressions; all run inside generated code or built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class words that describe a name rather than being part of it.
CLASS_TAIL = r"(?i)\s+(benchmark|corpus|dataset|method|approach|material)$"


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z and 0-9."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def surface_key(c: Column) -> Column:
    """Case, blanks and punctuation fold together: ``Harbor-31`` equals ``harbor 31``."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def entity_key(c: Column) -> Column:
    """``surface_key`` without a trailing class word."""
    return surface_key(F.regexp_replace(F.trim(c), CLASS_TAIL, ""))


def class_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+", "")


def leading_value(c: Column) -> Column:
    """A leading decimal in two places, else null: ``0.74 score`` gives ``0.74``, ``Harbor-31`` nothing."""
    found = F.regexp_extract(c, r"^\s*(\d*\.\d+)(?![\d.])", 1)
    return F.when(found != "", F.format_string("%.2f", found.cast("double")))


def snake(c: Column) -> Column:
    """camelCase and blanks to snake_case."""
    return F.replace(F.lower(F.regexp_replace(F.trim(c), "(?<!^)(?=[A-Z])", "_")), F.lit(" "), F.lit("_"))


def clean_title(c: Column) -> Column:
    """Join key of titles: lower case, other than letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def draw(*parts: Column) -> Column:
    """A reproducible draw from 0 to 2^32 - 1 that any SQL engine can repeat: 32 bits of md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")
