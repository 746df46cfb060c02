"""Provider frames with their own column names, mapped to raw observations and bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import known_text, number, strip
from tidemark.functions.normalize import etf_symbol, local_day, lots_to_shares, optional_date
from tidemark.operators.observations import insert_once
from tidemark.sources.connectors import require_columns

# The providers' column names, by the field that each fills.
SPOT_COLUMNS = {"code": "代码", "fund_name": "名称", "iopv": "IOPV实时估值", "shares": "最新份额", "data_date": "数据日期", "updated": "更新时间"}
SCALE_COLUMNS = {"code": "基金代码", "fund_name": "基金简称", "fund_type": "基金类别", "list_date": "上市日期", "shares": "基金份额", "fund_company": "基金管理人", "nav": "净值"}
HISTORY_COLUMNS = {"day": "日期", "open": "开盘", "close": "收盘", "high": "最高", "low": "最低", "lots": "成交量", "turnover": "成交额"}
SPOT_SOURCE, SCALE_SOURCE, HISTORY_SOURCE = "akshare:fund_etf_spot_em", "akshare:fund_etf_scale_szse", "akshare:fund_etf_hist_em"
ETF = "ETF"
OPTIONAL = {"fund_name": "string", "fund_type": "string", "fund_company": "string", "list_date": "date", "nav": "decimal(38,18)", "iopv": "decimal(38,18)", "shares": "decimal(38,18)"}


def _named(frame: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the declared columns, under their field names; a lacking one is a break of the provider's schema."""
    require_columns(frame, list(columns.values()))
    return frame.select(*[F.col(f"`{name}`").cast("string").alias(field) for field, name in columns.items()])


def payload_hash(columns: dict[str, str]) -> Column:
    """SHA-256 of the declared columns, so that columns that a provider adds do not make a row look new."""
    return F.sha2(F.to_json(F.struct(*[F.col(f).alias(columns[f]) for f in sorted(columns)]), {"ignoreNullFields": "false"}), 256)


def _observation(rows: DataFrame, values: dict[str, Column], columns: dict[str, str], source: str, snapshot_at: Column) -> DataFrame:
    missing = lambda n: F.lit(None).cast(OPTIONAL[n])
    return rows.select(
        etf_symbol("code").alias("symbol"), *[(values[n].cast(OPTIONAL[n]) if n in values else missing(n)).alias(n) for n in OPTIONAL],
        local_day(snapshot_at).alias("effective_from"), snapshot_at.alias("snapshot_at"), snapshot_at.alias("available_time"), snapshot_at.alias("ingest_time"),
        F.lit(source).alias("source"), F.lit("snapshot_only").alias("availability_class"), payload_hash(columns).alias("provider_payload_hash"),
    ).where("symbol IS NOT NULL")


def spot_observations(frame: DataFrame, snapshot_at: Column) -> DataFrame:
    """Spot frame to observations; rows whose code is of no exchange are left out, placeholders are unknown."""
    rows = _named(frame, SPOT_COLUMNS)
    return _observation(rows, {"fund_name": known_text("fund_name"), "iopv": number("iopv"), "shares": number("shares")}, SPOT_COLUMNS, SPOT_SOURCE, snapshot_at)


def scale_observations(frame: DataFrame, snapshot_at: Column) -> DataFrame:
    """Scale frame to observations of exchange-traded funds only."""
    rows = _named(frame, SCALE_COLUMNS).where(F.upper(strip("fund_type")) == ETF)
    values = {n: known_text(n) for n in ("fund_name", "fund_type", "fund_company")} | {n: number(n) for n in ("nav", "shares")} | {"list_date": optional_date("list_date")}
    return _observation(rows, values, SCALE_COLUMNS, SCALE_SOURCE, snapshot_at)


def history_bars(frame: DataFrame, symbol: str, retrieved_at: Column) -> DataFrame:
    """Unadjusted history to raw bars: volumes of whole lots become shares, prices stay text."""
    rows = _named(frame, HISTORY_COLUMNS)
    stamp = F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(optional_date("day")).cast("long") * 86_400), "Asia/Shanghai")
    return rows.select(
        F.lit(symbol).alias("symbol"), "open", "high", "low", "close", lots_to_shares("lots").alias("volume"), "turnover", stamp.alias("provider_timestamp"), retrieved_at.alias("retrieved_at"),
        F.lit(HISTORY_SOURCE).alias("provider"), F.lit("historical_latest").alias("historical_data_semantics"),
    )


def snapshot(existing: DataFrame | None, *feeds: DataFrame) -> DataFrame:
    """The observations of several feeds that are not stored yet, relabelled as collected forward; a second call adds none."""
    rows = feeds[0]
    for f in feeds[1:]:
        rows = rows.unionByName(f)
    key = F.sha2(F.concat_ws("|", "symbol", "source", F.unix_micros("snapshot_at").cast("string"), "provider_payload_hash"), 256)
    return insert_once(existing, rows.withColumn("availability_class", F.lit("forward_collected_pit")).withColumn("observation_key", key), "observation_key")
