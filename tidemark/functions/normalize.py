"""Normalisation of provider values and the small scalar functions of the engine, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import DIGITS, WIDE_DIGITS, known_text, number, strip, utc_day

# Fixed values of the market: its zone, session, code prefixes and suffixes.
MARKET_ZONE = "Asia/Shanghai"
SESSION_OPEN_MINUTES, SESSION_CLOSE_MINUTES = 9 * 60 + 30, 15 * 60
EXCHANGE_OF_SUFFIX = {"SH": "SH", "SS": "SH", "XSHG": "SH", "SZ": "SZ", "XSHE": "SZ", "SHE": "SZ"}
ETF_PREFIXES = ("15", "16", "50", "51", "52", "56", "58")
EXCHANGE_OF_FIRST_DIGIT = {"5": "SH", "1": "SZ"}
SHARES_A_LOT = 100
DAYS_A_YEAR = 365.25
REDUNDANCY_BANDS = ((0.60, "LOW_MODERATE"), (0.75, "MODERATE"), (0.90, "HIGH"))


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- time ---

def local_day(ts: Column | str, zone: str = MARKET_ZONE) -> Column:
    """The calendar day of an instant in a zone, whatever the session's zone."""
    return utc_day(F.from_utc_timestamp(_c(ts), zone))


def instant(day: Column | str, minutes: int, zone: str = MARKET_ZONE) -> Column:
    """The instant of a local time of day."""
    return F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(_c(day)).cast("long") * 86_400 + minutes * 60), zone)


def session_close(day: Column | str) -> Column:
    return instant(day, SESSION_CLOSE_MINUTES)


def session_open(day: Column | str) -> Column:
    return instant(day, SESSION_OPEN_MINUTES)


def policy_id(version: str, delay_seconds: int) -> str:
    """``daily_bar_eod_v1_15m`` for whole minutes, seconds otherwise."""
    return f"daily_bar_eod_{version}_{delay_seconds // 60}m" if delay_seconds % 60 == 0 else f"daily_bar_eod_{version}_{delay_seconds}s"


def plus_seconds(ts: Column | str, seconds: int) -> Column:
    return F.timestamp_micros(F.unix_micros(_c(ts)) + seconds * 1_000_000)


def provider_time(c: Column | str) -> Column:
    """An instant from epoch seconds or an ISO text; texts without zone are UTC; unreadable ones raise."""
    text = _c(c).cast("string")
    seconds = F.when(text.rlike(r"^[0-9]+(\.[0-9]+)?$"), F.timestamp_seconds(text.try_cast("double")))
    zoned = F.when(text.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.when(text.isNotNull(), F.coalesce(seconds, F.try_to_timestamp(zoned), F.raise_error(F.concat(F.lit("unreadable provider time: "), text)).cast("timestamp")))


# --- numbers and dates ---

def strict_decimal(c: Column | str, name: str, kind: str = "decimal(28,8)") -> Column:
    """The number, or an error where it is missing, unreadable, infinite or has more decimals than ``kind`` keeps."""
    exact, kept = number(c), number(c).try_cast(kind)
    message = F.concat(F.lit(f"{name} is missing or invalid: "), F.coalesce(_c(c).cast("string"), F.lit("null")))
    return F.when(kept.isNotNull() & (kept == exact), kept).otherwise(F.raise_error(message).cast(kind))


def optional_date(c: Column | str) -> Column:
    """A date from ``yyyy-MM-dd``, ``yyyy/MM/dd`` or ``yyyyMMdd``, longer texts cut; null where unknown or unreadable."""
    text = F.substring(F.replace(known_text(c), F.lit("/"), F.lit("-")), 1, 10)
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))


def lots_to_shares(c: Column | str) -> Column:
    """Whole shares of a number of lots; an error where they are not whole."""
    shares = number(c) * SHARES_A_LOT
    return F.when(shares.isNull() | (shares == F.floor(shares)), shares.cast("long")).otherwise(F.raise_error(F.lit("lots do not make whole shares")).cast("long"))


# --- symbols ---

def exchange_of(symbol: Column | str) -> Column:
    """The exchange named in any notation of a symbol, else UNKNOWN."""
    mark = F.regexp_extract(F.upper(F.translate(_c(symbol), WIDE_DIGITS, DIGITS)), r"(XSHG|XSHE|SHE|SH|SZ|SS)", 1)
    choice = F.lit("UNKNOWN")
    for suffix, exchange in EXCHANGE_OF_SUFFIX.items():
        choice = F.when(mark == suffix, exchange).otherwise(choice)
    return choice


def canonical_symbol(symbol: Column | str) -> Column:
    """``123456.SH`` or ``.SZ`` after trimming and upper-casing, else null."""
    text = F.upper(strip(symbol))
    return F.when(text.rlike(r"^[0-9]{6}\.(SH|SZ)$"), text)


def etf_symbol(code: Column | str) -> Column:
    """A bare fund code with the exchange its first digit stands for, else null."""
    text = strip(code)
    choice = F.lit(None).cast("string")
    for digit, exchange in EXCHANGE_OF_FIRST_DIGIT.items():
        choice = F.when(text.startswith(digit), F.concat(text, F.lit("."), F.lit(exchange))).otherwise(choice)
    return F.when(text.rlike("^[0-9]{6}$"), choice)


def instrument_type(symbol: Column | str, board: Column | str) -> Column:
    prefix = F.substring(_c(symbol), 1, 2)
    return F.when(F.contains(F.lower(_c(board)), F.lit("index")), "INDEX").when(prefix.isin(*ETF_PREFIXES), "ETF").otherwise("STOCK")


def first_known(*names: Column | str) -> Column:
    """The first known text, for a chain of names."""
    return F.coalesce(*[known_text(n) for n in names])


# --- derived values ---

def relative_difference(a: Column | str, b: Column | str) -> Column:
    """|a - b| over the greater magnitude; 0 for two zeros; null if either is null."""
    a, b = _c(a).cast("double"), _c(b).cast("double")
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(a.isNull() | b.isNull(), None).when(most == 0, 0.0).otherwise(F.try_divide(F.abs(a - b), most))


def tolerance_ratio(value: Column, tolerance: float) -> Column:
    """The value in tolerances; with tolerance 0 anything but 0 is infinite."""
    return F.when(value == 0, 0.0).otherwise(F.lit(float("inf"))) if tolerance == 0 else value / F.lit(tolerance)


def redundancy_band(rho: Column | str) -> Column:
    rho = F.nanvl(_c(rho), F.lit(None).cast("double"))
    band = F.when(rho.isNull(), "INSUFFICIENT_DATA")
    for limit, name in REDUNDANCY_BANDS:
        band = band.when(rho < limit, name)
    return band.otherwise("VERY_HIGH")


def structural(full: Column | str, rolling_median: Column | str) -> Column:
    number_of = lambda c: F.nanvl(_c(c), F.lit(None).cast("double"))
    return F.coalesce((number_of(full) >= 0.90) & (number_of(rolling_median) >= 0.85), F.lit(False))


def history_flag(first: Column | str, last: Column | str) -> Column:
    years = F.date_diff(_c(last), _c(first)) / F.lit(DAYS_A_YEAR)
    return F.when(years.isNull(), None).when(years < 3, "VERY_SHORT_HISTORY").when(years < 5, "SHORT_HISTORY").otherwise("OK")


def correlation_distance(rho: Column | str) -> Column:
    return F.sqrt(F.lit(0.5) * (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _c(rho)))))


def history_status(day: Column | str, launch: Column | str) -> Column:
    return F.when(_c(launch).isNull(), None).when(_c(day) < _c(launch), "BACKFILLED").otherwise("LIVE")


def freshness(as_of: Column, seen_at: Column, max_age_seconds: Column) -> Column:
    age = F.unix_micros(as_of) - F.unix_micros(seen_at)
    return F.when(max_age_seconds.isNull(), "NOT_APPLICABLE").when(age <= max_age_seconds * 1_000_000, "FRESH").otherwise("EXPIRED")


def redacted(text: Column | str) -> Column:
    """Credentials in free text replaced by stars."""
    return F.regexp_replace(_c(text), r"(?i)((?:app_key|app_secret|access_token|token|secret|password)\s*[=:]\s*)[^\s,;&]+", "$1***")


# --- bars ---

def normalize_bars(raw: DataFrame, *, version: str = "v1", delay_seconds: int = 900) -> DataFrame:
    """Canonical bars of raw ones: the local trade date, its session close, the availability policy and exact decimals.

    Any missing or invalid number is an error, as a canonical bar has none.
    """
    day = local_day("provider_timestamp")
    return raw.select(
        canonical_symbol("symbol").alias("symbol"), day.alias("trade_date"),
        *[strict_decimal(f, f).alias(f) for f in ("open", "high", "low", "close")],
        F.col("volume").cast("long").alias("volume"), strict_decimal("turnover", "turnover", "decimal(38,4)").alias("turnover"),
        session_close(day).alias("data_time"), plus_seconds(session_close(day), delay_seconds).alias("available_time"), F.col("retrieved_at").alias("ingest_time"),
        F.col("provider").alias("source"), F.lit(policy_id(version, delay_seconds)).alias("availability_policy_id"), F.col("historical_data_semantics"),
    )
