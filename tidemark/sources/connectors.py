"""Provider connectors at the engine's edge: a protocol, ordered calls with retry, and chunked requests.

Providers need the network and keys, so their clients are passed in; tests pass fakes. What comes back is rows for
``createDataFrame`` with the raw schema, numbers as text. Nothing here is on the data path of a query.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_BAR_SCHEMA = "symbol string, open string, high string, low string, close string, volume long, turnover string, provider_timestamp timestamp, retrieved_at timestamp, provider string, sdk_version string, historical_data_semantics string, provider_payload string"
LEVEL_SCHEMA = "observation_date date, level double, symbol string, provider string, retrieved_at timestamp, sdk_version string, historical_data_semantics string"
TRADING_DAYS_CHUNK, INDEX_HISTORY_CHUNK = 28, 366


class ProviderError(Exception):
    """A failed call; ``transient`` ones may be tried again."""

    def __init__(self, message: str, transient: bool = False):
        super().__init__(message)
        self.transient = transient


class SchemaBreak(ProviderError):
    """A provider's answer lacks columns that it must have."""


class BarProvider(Protocol):
    def instruments(self, symbols: list[str]) -> list[dict[str, Any]]: ...
    def daily_bars(self, symbol: str, start: date, end: date) -> list[dict[str, Any]]: ...
    def trading_days(self, market: str, start: date, end: date) -> list[date]: ...
    def quotes(self, symbols: list[str]) -> list[dict[str, Any]]: ...


def with_retry(call: Callable[[], Any], *, attempts: int = 3, base_seconds: float = 0.5, sleep: Callable[[float], None] = time.sleep) -> Any:
    """Only transient errors are tried again, after base, twice the base, and so on."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except ProviderError as error:
            if not error.transient or n == attempts:
                raise
            sleep(base_seconds * 2 ** (n - 1))
    return None


def chunks(start: date, end: date, days: int) -> Iterator[tuple[date, date]]:
    """Consecutive closed ranges of at most ``days`` days."""
    while start <= end:
        stop = min(end, start + timedelta(days=days - 1))
        yield start, stop
        start = stop + timedelta(days=1)


def chunked(fetch: Callable[[date, date], list[Any]], start: date, end: date, days: int, **retry: Any) -> list[Any]:
    return [row for a, b in chunks(start, end, days) for row in with_retry(lambda a=a, b=b: fetch(a, b), **retry)]


def fetch_bars(spark: SparkSession, provider: BarProvider, missing: DataFrame, key: str = "symbol", *, on_executors: bool = False, **retry: Any) -> DataFrame:
    """Fetch the missing ranges ``(key, first_day, last_day)``, in order one after the other, or on the executors.

    ``on_executors`` sends the provider to the tasks, so it must be picklable; each task then asks for its own ranges, and no
    bar passes through the driver. Providers that allow one caller only are asked from the driver.
    """
    if not on_executors:
        rows = [r for m in missing.orderBy(key, "first_day").collect() for r in with_retry(lambda m=m: provider.daily_bars(m[key], m.first_day, m.last_day), **retry)]
        return spark.createDataFrame(rows, RAW_BAR_SCHEMA)
    names = [part.strip().split(" ")[0] for part in RAW_BAR_SCHEMA.split(",")]

    def ask(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for m in part.itertuples(index=False):
                found = with_retry(lambda m=m: provider.daily_bars(m[0], m[1], m[2]), **retry)
                yield pd.DataFrame([[r.get(n) for n in names] for r in found], columns=names)

    return missing.select(key, "first_day", "last_day").mapInPandas(ask, RAW_BAR_SCHEMA)


def require_columns(df: DataFrame, wanted: list[str]) -> DataFrame:
    lacking = sorted(set(wanted) - set(df.columns))
    if lacking:
        raise SchemaBreak(f"missing columns {lacking}")
    return df


def index_levels(spark: SparkSession, answer: str, code: str) -> DataFrame:
    """``(observation_date, level, symbol)`` of an index-performance answer; a failed, empty or foreign answer raises."""
    content = json.loads(answer)
    if not content.get("success") or not content.get("data"):
        raise ProviderError("the answer holds no data")
    if {r["indexCode"] for r in content["data"]} != {code}:
        raise ProviderError(f"the answer is not about {code}")
    rows = spark.createDataFrame([(r["tradeDate"], float(r["close"]), r["indexCode"]) for r in content["data"]], "d string, level double, symbol string")
    return rows.select(F.to_date("d", "yyyyMMdd").alias("observation_date"), "level", "symbol")


def last_per_day(levels: DataFrame) -> DataFrame:
    """One level per symbol and day, the last retrieved."""
    return levels.groupBy("symbol", "observation_date").agg(F.max_by("level", "retrieved_at").alias("level"))


def probe(static: DataFrame, history: DataFrame, symbol: str) -> str:
    """RESOLVED if exactly one listing of the symbol exists, is named and has no other status than listed, and there is history."""
    own = static.where(F.col("symbol") == symbol)
    named = F.coalesce(F.trim("name"), F.lit("")) != "" if "name" in static.columns else F.lit(True)
    listed = F.coalesce(F.lower("status"), F.lit("listed")) == "listed" if "status" in static.columns else F.lit(True)
    rows = own.select((named & listed).alias("good")).limit(2).collect()
    one = len(rows) == 1 and rows[0].good
    return "RESOLVED" if one and not history.where(F.col("symbol") == symbol).limit(1).isEmpty() else "UNRESOLVED"


def read_level_cache(spark: SparkSession, path: str, semantics: str = "historical_latest") -> DataFrame:
    """A CSV cache of benchmark levels by day; other semantics than asked for raise."""
    require_columns(spark.read.option("header", True).csv(path), ["observation_date", "level", "symbol", "historical_data_semantics"])
    names = spark.read.option("header", True).csv(path).columns
    kinds = dict(part.strip().split(" ") for part in LEVEL_SCHEMA.split(","))
    levels = spark.read.option("header", True).schema(", ".join(f"`{n}` {kinds.get(n, 'string')}" for n in names)).csv(path)
    if not levels.where(F.col("historical_data_semantics") != semantics).limit(1).isEmpty():
        raise ProviderError(f"the cache holds other semantics than {semantics}")
    return levels.orderBy("symbol", "observation_date")


def read_raw_cache(spark: SparkSession, path: str, start: date | None = None, end: date | None = None) -> DataFrame:
    """A JSON cache of raw bars (one record a line, any folder layout) between two provider days, in retrieval order."""
    rows = spark.read.schema(RAW_BAR_SCHEMA).option("recursiveFileLookup", True).json(path)
    day = F.to_date("provider_timestamp")
    return rows.where((F.lit(start).isNull() | (day >= F.lit(start))) & (F.lit(end).isNull() | (day <= F.lit(end)))).orderBy("symbol", "provider_timestamp", "retrieved_at")


def capability(call: Callable[[], Any], has_credentials: bool = True) -> str:
    """The outcome of trying a provider's call: PASS, FAIL, NO_PERMISSION or NO_CREDENTIAL."""
    if not has_credentials:
        return "NO_CREDENTIAL"
    try:
        return "PASS" if call() else "FAIL"
    except PermissionError:
        return "NO_PERMISSION"
    except ProviderError:
        return "FAIL"
