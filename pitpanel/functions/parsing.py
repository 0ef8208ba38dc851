"""Text to typed values, and text classification, as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Date layouts a multi-year file series mixes, in the order tried.
DATE_FORMATS = ("yyyy-MM-dd", "dd-MMM-yyyy", "dd-MMM-yy")

# Construction-age bands, upper start year (inclusive) and label.
AGE_BANDS = ((1929, "pre_1930"), (1975, "1930_1975"), (1995, "1976_1995"))
LAST_AGE_BAND = "post_1996"

# Wall classes by keyword, first match wins.
WALL_CLASSES = (
    ("cavity", "cavity"),
    ("solid", "solid"),
    ("timber|system|cob|granite|sandstone", "other"),
)

# Insulation phrases; the negative ones contain the positive word.
NOT_INSULATED = "no insulation|as built"
INSULATED = "insulat|filled cavity"

# White space in the Unicode sense.
WHITESPACE = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

# Efficiency ratings counted as poor.
POOR_RATINGS = ("poor", "very poor")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Double, or NULL for text that is no number; NaN counts as missing."""
    parsed = _col(value).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def whole_number(value: Column | str) -> Column:
    return _col(value).try_cast("int")


def parse_date(value: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First layout that fits; NULL when none does (guard with ``require_parsed``)."""
    text = F.trim(_col(value))
    tries = []
    for fmt in formats:
        day = F.try_to_timestamp(text, F.lit(fmt)).cast("date")
        if "yy" in fmt and "yyyy" not in fmt:
            # Two-digit years 69..99 mean 19xx; the parser alone reads 20xx.
            day = F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)
        tries.append(day)
    return F.coalesce(*tries)


def parse_clock(value: Column | str, fmt: str = "dd/MM/yyyy HH:mm:ss") -> Column:
    """Wall-clock timestamp without zone, NULL when it does not fit."""
    return F.try_to_timestamp(F.trim(_col(value)), F.lit(fmt)).cast("timestamp_ntz")


def within(value: Column | str, low: float, high: float) -> Column:
    """The value when strictly inside (low, high), else NULL."""
    x = _col(value)
    return F.when((x > low) & (x < high), x)


def normalise_key(value: Column | str) -> Column:
    """Upper case, all whitespace removed (character by character; no pattern matching)."""
    return F.upper(F.translate(_col(value), WHITESPACE, ""))


def outward_key(value: Column | str, *, tail: int = 3) -> Column:
    """Coarse part of a key: all but the last ``tail`` characters, NULL when nothing is left."""
    key = normalise_key(value)
    return F.when(F.length(key) > tail, F.substring(key, F.lit(1), F.length(key) - F.lit(tail)))


def first_year(value: Column | str) -> Column:
    """First run of four digits as an integer."""
    return F.nullif(F.regexp_extract(_col(value), r"(\d{4})", 1), F.lit("")).try_cast("int")


def age_band(value: Column | str) -> Column:
    """Band of the first year in a text, NULL without one."""
    return year_band(first_year(value))


def year_band(year: Column) -> Column:
    label = F.when(year.isNotNull(), F.lit(LAST_AGE_BAND))
    for limit, name in reversed(AGE_BANDS):
        label = F.when(year <= limit, F.lit(name)).otherwise(label)
    return label


def keyword_class(value: Column | str, classes: Sequence[tuple[str, str]] = WALL_CLASSES) -> Column:
    """Label of the first pattern found in the lower-cased text, NULL when none is."""
    text = F.lower(_col(value))
    label = F.lit(None).cast("string")
    for pattern, name in reversed(list(classes)):
        label = F.when(text.rlike(pattern), F.lit(name)).otherwise(label)
    return label


def phrase_flag(value: Column | str, negative: str = NOT_INSULATED, positive: str = INSULATED) -> Column:
    """False for a negative phrase, True for a positive one, NULL for neither."""
    text = F.lower(_col(value))
    return F.when(text.rlike(negative), F.lit(False)).when(text.rlike(positive), F.lit(True))


def is_yes(value: Column | str) -> Column:
    return F.upper(_col(value)) == F.lit("Y")


def rated_poor(value: Column | str, ratings: Sequence[str] = POOR_RATINGS) -> Column:
    return F.lower(_col(value)).isin(*ratings)


def code_in_label(value: Column | str, codes: Sequence[str], *, prefix: str = "LDZ") -> Column:
    """Known code written in parentheses after ``prefix``, NULL when absent or unknown."""
    code = F.regexp_extract(_col(value), prefix + r"\s*\(([A-Z0-9]+)\)", 1)
    return F.when(code.isin(*codes), code)
