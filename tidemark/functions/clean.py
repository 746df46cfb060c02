"""Column expressions that bring dirty feed values into one notation. All run inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks that may surround a value, and texts that mean "unknown" (compared in lower case).
BLANKS = " \t\r\n 　"
UNKNOWN_TEXTS = ("", "-", "--", "---", "n/a", "na", "nan", "nat", "none", "null", "unknown", "?")
WIDE_DIGITS, DIGITS = "０１２３４５６７８９", "0123456789"

NUMBER = "decimal(38,12)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(BLANKS))


def token(c: Column | str) -> Column:
    """Case and surrounding blanks removed: for sources, modes and other closed vocabularies."""
    return F.lower(strip(c))


def known_text(c: Column | str) -> Column:
    """The stripped text, or null where it is null, blank or a placeholder."""
    text = strip(c)
    return F.when(~F.lower(text).isin(*UNKNOWN_TEXTS), text)


def six_digits(c: Column | str) -> Column:
    """The six digits that name a fund or an index in any notation (``700000.SH``, ``SH:700000``, wide digits), else null."""
    plain = F.translate(_col(c), WIDE_DIGITS, DIGITS)
    return F.nullif(F.regexp_extract(plain, r"(?<![0-9])([0-9]{6})(?![0-9])", 1), F.lit(""))


def number(c: Column | str) -> Column:
    """A number written as text (grouping commas, exponent, blanks), or null where unknown or unreadable."""
    return F.regexp_replace(known_text(c), ",", "").try_cast(NUMBER)


def utc_day(ts: Column | str) -> Column:
    """The UTC day of a timestamp, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(_col(ts)) / F.lit(86_400_000_000)).cast("int"))


def iso(day: Column | str) -> Column:
    """A date as ``yyyy-MM-dd``."""
    return _col(day).cast("string")


def monday(day: Column | str) -> Column:
    """The Monday that begins the week of a date."""
    return F.date_sub(F.next_day(_col(day), "Mon"), 7)
