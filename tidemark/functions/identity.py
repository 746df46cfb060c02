"""Content-addressed keys: canonical text of values, key-sorted JSON and SHA-256. All as column expressions."""

from __future__ import annotations

import hashlib
import json
from datetime import date
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The bar fields that make up its value hash, and the order of those in its observation id.
VALUE_FIELDS = ("close", "data_time", "high", "low", "open", "source", "symbol", "trade_date", "turnover", "volume")
RAW_VALUE_FIELDS = ("open", "high", "low", "close", "volume", "turnover", "provider_timestamp", "provider")


def canonical_decimal(c: Column | str) -> Column:
    """Plain notation without trailing zeros: ``4.10`` is ``4.1``, ``100.0`` is ``100``."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    plain = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(plain.isin("-0", "0E-8", "0E-10"), "0").otherwise(plain)


def canonical_time(c: Column | str) -> Column:
    """UTC with microseconds and ``+00:00``, whatever the session's time zone."""
    shifted = F.to_utc_timestamp(F.col(c) if isinstance(c, str) else c, F.current_timezone())
    return F.concat(F.date_format(shifted, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def sorted_json(values: dict[str, Column], ascii_only: bool = False, plain: tuple[str, ...] = ()) -> Column:
    """Compact JSON with sorted keys; nulls are kept. Non-ASCII characters are escaped only if asked for.

    ``plain`` names values that are ASCII by their making; runs of them are written at once and never looked through.
    """
    to_json = lambda names: F.to_json(F.struct(*[values[k].alias(k) for k in names]), {"ignoreNullFields": "false"})
    if not ascii_only:
        return to_json(sorted(values))
    parts = []
    for is_plain, run in groupby(sorted(values), key=lambda k: k in plain):
        text = _inside(to_json(list(run)))
        parts.append(text if is_plain else F.when(text.rlike(r"[^\x00-\x7F]"), _escaped(text)).otherwise(text))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _inside(text: Column) -> Column:
    """A JSON object's text without its braces."""
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _escaped(text: Column) -> Column:
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def one(ch: Column) -> Column:
        code = F.ascii(ch)
        over = code - 0x10000
        pair = F.concat(unit((F.lit(0xD800) + F.shiftright(over, 10)).cast("long")), unit((F.lit(0xDC00) + over.bitwiseAND(0x3FF)).cast("long")))
        return F.when(code < 128, ch).when(code < 0x10000, unit(code.cast("long"))).otherwise(pair)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def value_hash(bar: dict[str, Column] | None = None) -> Column:
    """SHA-256 of a bar's economic content. Availability, policy and semantics are no part of it."""
    get = (lambda n: bar[n]) if bar else F.col
    numbers = {n: canonical_decimal(get(n)) for n in ("open", "high", "low", "close", "turnover")}
    texts = {"symbol": get("symbol"), "source": get("source"), "trade_date": get("trade_date").cast("string"), "data_time": canonical_time(get("data_time")), "volume": get("volume").cast("long")}
    return F.sha2(sorted_json(numbers | texts, ascii_only=True, plain=(*numbers, "trade_date", "data_time", "volume")), 256)


def observation_id(hash_of_value: Column | None = None) -> Column:
    """SHA-256 of what makes a stored revision unique. A null part is an empty text."""
    parts = [F.col("symbol"), F.col("trade_date").cast("string"), F.col("source"), canonical_time("ingest_time"), hash_of_value if hash_of_value is not None else value_hash(), F.col("availability_policy_id"), canonical_time("available_time")]
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def stable_id(values: dict[str, Column], without: tuple[str, ...] = ("ingest_time", "available_time")) -> Column:
    """SHA-256 of a payload without its observation times, so that the first observation of a content holds."""
    return F.sha2(sorted_json({k: v for k, v in values.items() if k not in without}), 256)


def with_bar_ids(bars: DataFrame) -> DataFrame:
    hashed = bars.withColumn("value_hash", value_hash())
    return hashed.withColumn("observation_id", observation_id(F.col("value_hash")))


def request_key(symbol: str, start: date, end: date, adjust: str, provider: str = "longbridge", endpoint: str = "daily_bars") -> str:
    """Key of one request to a provider (on the driver)."""
    content = {"adjust_type": adjust, "end_date": end.isoformat(), "endpoint": endpoint, "provider": provider, "start_date": start.isoformat(), "symbol": symbol.strip().upper()}
    return hashlib.sha256(json.dumps(content, separators=(",", ":"), sort_keys=True).encode()).hexdigest()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, sha256)`` of whole files, to pin the version of a registry."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
